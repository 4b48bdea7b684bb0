"""Operator 7 against its SQL, and literal cases: order, nulls, repeats, several batches, colliding digests."""

from collections import defaultdict
import re

import pytest
from pyspark.sql import functions as F

from inkwell.llm import exact_dedup as X
from tests.conftest import MID
from tests.oracle import compare, duck_connect

ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a\x0b\x0c\r\n b"), (4, "a b"), (1, None), (2, ""), (7, " "), (8, "\n\t"),
        (None, "a b"), (None, "only"), (6, "x" * 300_000), (10, "x" * 300_000), (3, "a b"), (11, "a b ")]
SCHEMA = "doc_id long, text string"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids)) for i in ids]
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size) for r in df.collect()], key=repr)


def test_against_sql(spark):
    r = compare(spark, duck_connect(MID), "op7", X.op7_exact_dedup, X.SQL, MID)
    assert r["status"] == "ok", r


def test_literal_rows_and_one_kept_each(spark):
    df = X.exact_groups(spark.createDataFrame([(*r, "k", 1) for r in ROWS], SCHEMA + ", digest string, kept int"))
    assert got(df) == brute(ROWS)
    kept = [r.doc_id for r in df.where("kept").collect()]
    assert sorted(kept, key=repr) == sorted([3, 4, 1, 7, None, 6, 11], key=repr)


def test_state_runs_over_several_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame(ROWS, SCHEMA).repartition(6).write.parquet(path)
    assert got(X.exact_groups(spark.read.parquet(path), files_per_batch=1)) == brute(ROWS)


def test_colliding_digests_fall_back_to_bytes(spark):
    df = X.exact_groups(spark.createDataFrame(ROWS, SCHEMA), digest=lambda t: F.substring(X.sha256(t), 1, 0))
    assert got(df) == brute(ROWS)


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(2, None), (1, None)]])
def test_small_and_empty(spark, rows):
    assert got(X.exact_groups(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_keep_first_returns_all_columns(spark):
    docs = spark.createDataFrame([(2, "a b", "en"), (1, "a  b", "de"), (3, "c", None)], SCHEMA + ", lang string")
    assert sorted(map(tuple, X.keep_first(docs).collect())) == [(1, "a  b", "de"), (3, "c", None)]
