"""Deletion along keys: cascades, references set to null, chains and cycles; no violation is left."""

import datetime as dt
import random

import pytest
from graphlib import CycleError

from inkwell.operators import ops as O
from inkwell.operators import retention as R

IDS = {"users": "user_id", "sources": "source_id", "stories": "story_id", "articles": "article_id", "snaps": "snap_id",
       "interactions": "event_id", "comments": "comment_id", "user_preferences": "pref_id", "notifications": "note_id"}


def made(spark, seed=3):
    rnd = random.Random(seed)
    ref = lambda n: rnd.choice([None, 0, rnd.randrange(n)])  # noqa: E731 - id 0 is the hot one
    rows = {
        "users": ([(i,) for i in range(12)], "user_id long"),
        "sources": ([(i,) for i in range(6)], "source_id long"),
        "stories": ([(i,) for i in range(8)], "story_id long"),
        "articles": ([(i, ref(6), ref(8)) for i in range(60)], "article_id long, source_id long, story_id long"),
        "snaps": ([(i, rnd.randrange(8)) for i in range(20)], "snap_id long, story_id long"),
        "interactions": ([(i, rnd.randrange(12), rnd.randrange(20)) for i in range(150)], "event_id long, user_id long, snap_id long"),
        "comments": ([(i, rnd.randrange(12), rnd.randrange(20), rnd.randrange(i) if i and rnd.random() < 0.7 else None) for i in range(150)],
                     "comment_id long, user_id long, snap_id long, parent_id long"),
        "user_preferences": ([(i, i) for i in range(12)], "pref_id long, user_id long"),
        "notifications": ([(i, rnd.randrange(12)) for i in range(40)], "note_id long, user_id long"),
    }
    return {n: spark.createDataFrame(*r) for n, r in rows.items()}


def brute(tables, doomed):
    """One row after another, until nothing changes."""
    rows = {n: {r[IDS[n]]: r.asDict() for r in df.collect()} for n, df in tables.items()}
    todo = [(n, i) for n, ids in doomed.items() for i in ids if i in rows[n]]
    while todo:
        n, i = todo.pop()
        if rows[n].pop(i, None) is None:
            continue
        for k in R.KEYS:
            if k.parent == n and k.child in rows:
                for j, r in rows[k.child].items():
                    if r[k.column] == i:
                        if k.rule == R.CASCADE:
                            todo.append((k.child, j))
                        else:
                            r[k.column] = None
    return rows


def ids_of(spark, doomed):
    return {n: spark.createDataFrame([(i,) for i in ids], "id long") for n, ids in doomed.items()}


@pytest.mark.parametrize("doomed", [
    {"stories": [0, 3], "sources": [0], "articles": [1, 2, 2, 999]}, {"users": [0], "comments": [1, 2]}, {"snaps": []}])
def test_cascade_equals_brute_force(spark, doomed):
    tables = made(spark)
    got = R.cascade(tables, IDS, ids_of(spark, doomed))
    want = brute(tables, doomed)
    for n, p in got.items():
        assert p.kept.columns == tables[n].columns
        assert {r[IDS[n]]: r.asDict() for r in p.kept.collect()} == want[n], n
    report = {r.table_name: r for r in R.cascade_report(got).collect()}
    assert {n: (r.before, r.kept, r.purged) for n, r in report.items()} == {
        n: (df.count(), len(want[n]), df.count() - len(want[n])) for n, df in tables.items()}
    was = {r.article_id: r for r in tables["articles"].collect()}
    assert report["articles"].nulled == sum(was[i][c] is not None and r[c] is None for i, r in want["articles"].items()
                                            for c in ("source_id", "story_id"))
    checks = [(f"{k.child}.{k.column}", O.fk_violations(got[k.child].kept, k.column, got[k.parent].kept, IDS[k.parent]))
              for k in R.KEYS]
    assert {r.violations for r in O.integrity_report(checks).collect()} == {0}


def test_chains_and_cycles(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)]
    ring = [(1000 + i, 1000 + (i + 1) % 40) for i in range(40)]
    odd = [(2000, 9999), (2001, 2001), (2002, 2001)]
    rows = spark.createDataFrame(chain + ring + odd, "comment_id long, parent_id long")
    below = lambda *ids: {r.comment_id for r in R.with_descendants(
        spark.createDataFrame([(i,) for i in ids], "comment_id long"), rows, "comment_id", "parent_id").collect()}
    assert below(100) == set(range(100, 300))
    assert below(1007) == set(range(1000, 1040))
    assert below(2001, 299) == {2001, 2002, 299}
    assert below() == set()


def test_missing_parents_and_empty_tables(spark):
    tables = {"stories": spark.createDataFrame([(1,), (2,)], "story_id long"),
              "articles": spark.createDataFrame([(1, 7), (2, None), (3, 1)], "article_id long, story_id long"),
              "snaps": spark.createDataFrame([], "snap_id long, story_id long")}
    got = R.cascade(tables, IDS, ids_of(spark, {"stories": [1, 7]}))
    assert sorted(map(tuple, got["stories"].kept.collect())) == [(2,)]
    assert sorted(map(tuple, got["articles"].kept.collect())) == [(1, 7), (2, None), (3, None)]
    assert got["snaps"].kept.count() == 0


def test_keys_round_several_tables_are_refused():
    keys = [R.Key("a", "b_id", "b"), R.Key("b", "a_id", "a")]
    with pytest.raises(CycleError):
        R.parents_first(["a", "b"], keys)
    assert R.parents_first(["comments", "snaps", "stories"], R.KEYS) == ["stories", "snaps", "comments"]


def test_dashboard_counts_duplicates_and_hours(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    articles = spark.createDataFrame(
        [(1, "s", at(1), "x"), (2, "s", at(1, 5), "x"), (3, "t", at(1, 5), "x"), (4, "t", at(2), "y"), (0, "s", at(2), "y"),
         (5, "s", at(3), ""), (6, "s", at(3), ""), (7, "s", at(3), None), (8, None, None, "z")],
        "article_id long, source_name string, publish_time timestamp_ntz, content string")
    log = spark.createDataFrame([("s", at(1), "error"), ("s", at(1, 9), "success"), ("u", at(4), None)],
                                "source_name string, ts timestamp_ntz, status string")
    got = {(r.source_name, r.hour and r.hour.hour): (r.articles, r.duplicates, r.scrapes, r.errors, r.error_rate)
           for r in O.ingest_dashboard(articles, log).collect()}
    assert got == {("s", 1): (2, 1, 2, 1, 0.5), ("t", 1): (1, 1, 0, 0, None), ("t", 2): (1, 1, 0, 0, None),
                   ("s", 2): (1, 0, 0, 0, None), ("s", 3): (3, 0, 0, 0, None), (None, None): (1, 0, 0, 0, None),
                   ("u", 4): (0, 0, 1, 0, 0.0)}
    assert O.ingest_dashboard(articles.limit(0), log.limit(0)).count() == 0
