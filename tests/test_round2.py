"""Cases behind the second round's fixes: nothing is dropped, cut short or moved by a session's settings."""

import datetime as dt

from pyspark.sql import functions as F

from inkwell.operators.components import connected_components
from inkwell.operators.parse import parse_time, repair_encoding
from inkwell.operators.similarity import near_dup_pairs
from inkwell.operators.users import comment_rejects, comment_threads
from inkwell.streaming.jobs import time_slices


def test_long_paths_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert {r.component for r in connected_components(edges).collect()} == {0}


def test_invalid_utf8_falls_back(spark):
    rows = [(1, "café".encode()), (2, "caf\xe9".encode("latin-1")), (3, b""), (4, None), (5, "नमस्ते".encode())]
    df = spark.createDataFrame(rows, "i int, b binary")
    got = {r.i: r.t for r in df.select("i", repair_encoding("b").alias("t")).collect()}
    assert got == {1: "café", 2: "café", 3: "", 4: None, 5: "नमस्ते"}


def test_zone_names(spark):
    rows = [("Tue, 02 Jan 2024 10:00:00 EST",), ("Tue, 02 Jan 2024 10:00:00 GMT",), ("02 Jan 2024 10:00 PDT",), ("nonsense EST",)]
    got = [r.t for r in spark.createDataFrame(rows, "s string").select(parse_time("s").alias("t")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 15), dt.datetime(2024, 1, 2, 10), dt.datetime(2024, 1, 2, 17), None]


def test_slices_keep_rows_without_time(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)] + [(100, None)], "i int, o double")
    assert [d.count() for d in time_slices(df, "o", 4)] == [26, 25, 25, 25]
    assert [d.count() for d in time_slices(df.limit(0), "o", 4)] == [0]
    assert sum(d.count() for d in time_slices(df.where("i = 7"), "o", 4)) == 1


def test_windows_ignore_the_session_time_zone(spark):
    rows = [(1, dt.datetime(2024, 3, 9, 12), [1.0, 0.0]), (2, dt.datetime(2024, 3, 11, 12, 30), [1.0, 0.0]),
            (3, dt.datetime(2024, 3, 11, 11), [1.0, 0.0])]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame(rows, "article_id long, publish_time timestamp_ntz, embedding array<double>")
            assert sorted((r.id_a, r.id_b) for r in near_dup_pairs(df).collect()) == [(1, 3), (2, 3)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_orphans_and_cycles_are_returned(spark):
    rows = [(1, 9, None), (2, 9, 1), (3, 9, 77), (4, 9, 5), (5, 9, 4)]
    df = spark.createDataFrame(rows, "comment_id long, item_id long, parent_id long")
    assert sorted(r.comment_id for r in comment_threads(df).collect()) == [1, 2]
    assert sorted(r.comment_id for r in comment_rejects(df).collect()) == [3, 4, 5]


def test_titles_are_whole(spark):
    from inkwell.sources.fixtures import articles
    from tests.conftest import MID
    assert articles(spark, MID).agg(F.max(F.length("title"))).first()[0] > 500
