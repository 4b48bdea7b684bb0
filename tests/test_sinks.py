"""Partitioned sinks: only touched partitions change, rows move with their date, repeated batches change nothing."""

import datetime as dt
import os

from inkwell.sources import sinks as S

SCHEMA = "url string, seq long, publish_time timestamp_ntz, publish_date date, archived boolean"


def batch(spark, *rows):
    made = [(u, n, d and dt.datetime(2024, 1, d, 9), d and dt.date(2024, 1, d), False) for u, n, d in rows]
    return spark.createDataFrame(made, SCHEMA)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(spark, path):
    df = S.read_keyed(spark, path, batch(spark).schema, "url")
    return sorted((r.url, r.seq, r.publish_date and r.publish_date.day) for r in df.collect())


def put(spark, path, *given):
    days = S.upsert(batch(spark, *given), path, "url", ["seq"], "publish_date")
    return sorted((d.day if d else 0) for d in days)


def test_upsert_touches_few_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert rows(spark, path) == []
    assert put(spark, path, ("a", 1, 1), ("b", 1, 2), ("c", 1, 3), ("c", 0, 5), ("d", 1, None), (None, 9, 4)) == [0, 1, 2, 3]
    first = files(path)
    # b moves to another day and leaves its own empty; a is older than what is there, c comes once more as it is.
    assert put(spark, path, ("b", 2, 3), ("a", 0, 3), ("c", 1, 3)) == [1, 2, 3]
    want = [("a", 1, 1), ("b", 2, 3), ("c", 1, 3), ("d", 1, None)]
    assert rows(spark, path) == want
    second = files(path)
    same = {f for f in first if "publish_date=__HIVE" in f}
    assert same and all(second.get(f) == first[f] for f in same)
    assert all(f not in second for f in first if f not in same)
    assert put(spark, path, ("b", 2, 3), ("a", 0, 3), ("c", 1, 3)) == [1, 3]
    assert rows(spark, path) == want
    # From the partition it moved to, and from none, on to others.
    assert put(spark, path, ("b", 3, 7), ("d", 2, 7)) == [0, 3, 7]
    assert rows(spark, path) == [("a", 1, 1), ("b", 3, 7), ("c", 1, 3), ("d", 2, 7)]
    assert put(spark, path) == []


def test_archive_writes_what_is_due(spark, tmp_path):
    path, schema = f"{tmp_path}/t", batch(spark).schema
    put(spark, path, ("a", 1, 1), ("b", 1, 2), ("c", 1, 20), ("d", 1, None))
    before = files(path)
    cut = lambda as_of: sorted(d.day for d in S.archive_partitions(spark, path, schema, as_of))
    flags = lambda: {r.url: r.archived for r in S.read_keyed(spark, path, schema, "url").collect()}
    assert cut("2024-01-15 10:00:00") == [1] and flags() == {"a": True, "b": False, "c": False, "d": False}
    after = files(path)
    assert {f.split("publish_date=")[1][:10] for f in before if f not in after} == {"2024-01-01"}
    assert cut("2024-01-15 10:00:00") == []
    assert cut("2024-01-16 08:59:59") == [] and cut("2024-01-16 09:00:00") == [2]
    assert rows(spark, path) == [("a", 1, 1), ("b", 1, 2), ("c", 1, 20), ("d", 1, None)]


def test_feeds_of_one_language_are_replaced(spark, tmp_path):
    feed = lambda *r: spark.createDataFrame(list(r), "user_id long, article_id long, position int, language string")
    path = f"{tmp_path}/feeds"
    S.overwrite_partitions(feed((1, 5, 1, "en"), (2, 6, 1, "de"), (1, 7, 2, "en")), path, "language")
    before = files(f"{path}/language=de")
    S.overwrite_partitions(feed((1, 8, 1, "en")), path, "language")
    assert files(f"{path}/language=de") == before
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 8, 1, "en"), (2, 6, 1, "de")]
