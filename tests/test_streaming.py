"""Streaming jobs: late events, repeated events and batches, timers and what stays in state."""

import datetime as dt
import os

from pyspark.sql import functions as F

from inkwell.operators import interactions as I
from inkwell.operators import trending as G
from inkwell.streaming import jobs as L
from inkwell.streaming import keyed as K
from inkwell.streaming import stores as S

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def drain(spark, tmp_path, schema, batches, job, name="s"):
    """Run ``job`` after each batch of rows is written."""
    src, out, ckpt = (str(tmp_path / f"{name}-{p}") for p in ("in", "out", "ckpt"))
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        own = K.keyed_session(spark)
        L.run_available_now(job(L.file_stream(own, src, spark.createDataFrame([], schema).schema)), out, ckpt)
    return spark.read.parquet(out), ckpt


def test_breaking_equals_g5_and_drops_late_events(spark, tmp_path):
    articles = spark.createDataFrame([(i, "en", "sports", at(10 * i)) for i in range(30)],
                                     "article_id long, language string, category_slug string, publish_time timestamp")
    rows = [(k % 30, at(10 * (k % 30) + (k * 7) % 45)) for k in range(400)] + [(99, at(1000)), (1, None), (None, at(5))]
    events = spark.createDataFrame(rows, "item_id long, ts timestamp")
    late = spark.createDataFrame([(2, at(25))], events.schema)  # the watermark is hours on by then
    a, e, out, ckpt = (str(tmp_path / p) for p in "aeoc")

    def run():
        L.run_available_now(L.stream_breaking(L.file_stream(spark, a, articles.schema), L.file_stream(spark, e, events.schema), 0.1), out, ckpt)

    far = spark.createDataFrame([(500, "en", "sports", at(1000))], articles.schema)
    articles.unionByName(far).write.parquet(a)
    events.write.parquet(e)
    run()
    late.write.mode("append").parquet(e)
    run()
    got = {(r.article_id, r.interactions) for r in spark.read.parquet(out).collect()}
    want = set()
    plain = articles.select("article_id", "language", F.lit("t").alias("title"), "category_slug", F.col("publish_time").cast("timestamp_ntz").alias("publish_time"))
    hits = events.select("item_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    for i in (0, 2, 13, 29):  # G5 just before the half hour after publication ends, when no event falls between
        as_of = at(10 * i + 30) - dt.timedelta(microseconds=1)
        rows = G.breaking(plain.where(F.col("article_id") == i), G.velocity(hits.where(F.col("ts") > at(10 * i)), as_of, 30), as_of, 0.1, 30)
        n_end = hits.where((F.col("item_id") == i) & (F.col("ts") == at(10 * i + 30))).count()
        want |= {(r.article_id, r.interactions + n_end) for r in rows.collect()}
    assert want and want <= got
    expected = {i: sum(x == i and t is not None and at(10 * i) < t <= at(10 * i + 30) for x, t in [tuple(r) for r in events.collect()]) for i in range(30)}
    assert got == {(i, n) for i, n in expected.items() if n / 30 > 0.1}


EVENT = "event_id long, ts timestamp, user_id long, item_id long, interaction_type string, action string"


def test_live_state_survives_repeats_and_disorder(spark, tmp_path):
    kinds = ["read", "like", "bookmark", "comment", "share", "like", "bookmark"]
    acts = ["read", "like", "bookmark", "comment", "share", "unlike", "unbookmark"]
    rows = [(i, at((i * 37) % 600), i % 3, (i * 5) % 4, kinds[i % 7], acts[i % 7]) for i in range(150)]
    third = [rows[i::3] for i in range(3)]  # each batch reaches over the whole time
    batches = [third[0] + third[0][:9], third[1] + third[0][5:20], rows[::-1][:60] + third[2]]
    changes, _ = drain(spark, tmp_path, EVENT, batches, K.stream_state)
    changes = changes.persist()
    frame = spark.createDataFrame(rows, EVENT)

    def same(a, b, order):
        assert sorted(map(tuple, a.select(order).collect())) == sorted(map(tuple, b.select(order).collect()))

    same(K.live_counts(changes), I.interaction_counts(frame), ["item_id", "reads", "likes", "comments", "shares", "bookmarks"])
    same(K.live_toggles(changes), I.toggle_state(frame), ["user_id", "item_id", "kind", "active", "last_ts"])


def test_live_state_is_one_value_a_key(spark, tmp_path):
    """A key costs one read and one write of state a batch; a repeat in a later batch still meets its stored toggle."""
    rows = [(1, at(0), 1, 1, "like", "like"), (2, at(5), 1, 1, "like", "unlike"), (3, at(1), 1, 1, "bookmark", "bookmark"), (4, at(2), 2, 1, "read", "read")]
    changes, ckpt = drain(spark, tmp_path, EVENT, [rows[1:], rows[:1] + rows[2:3]], K.stream_state, "v")
    got = {(r.user_id, r.kind): (r.active, r.last_ts) for r in K.live_toggles(changes).collect()}
    assert got == {(1, "like"): (False, at(5)), (1, "bookmark"): (True, at(1))}
    left = K.keyed_session(spark).read.format("statestore").option("stateVarName", "state").load(ckpt)
    assert left.count() == 2


def test_comment_limit_clears_its_state(spark, tmp_path):
    rows = [(i, at(i * 20), i % 2, i, "comment", "comment") for i in range(200)] + [(1000, at(30), 0, 0, "read", "read")]
    batches = [rows[:90], rows[90:], [(2000, at(10), 0, 7, "comment", "comment")], [(3000, at(60 * 24 * 9), 5, 7, "read", "read")],
               [(4000, at(60 * 24 * 9 + 1), 6, 1, "comment", "comment")], [(5000, at(60 * 24 * 20), 6, 1, "comment", "comment")]]
    got, ckpt = drain(spark, tmp_path, EVENT, batches, lambda s: K.stream_limit_comments(s, 5), "c")
    frame = spark.createDataFrame(rows + batches[4] + batches[5], EVENT)
    want = I.limit_comments(frame, 5)
    cols = ["user_id", "day", "event_id", "day_rank"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    # 2000 came days late. After the last watermark only the newest day is still in state.
    left = K.keyed_session(spark).read.format("statestore").option("stateVarName", "count").load(ckpt)
    assert [r[0].asDict()["day"] for r in left.select("key").collect()] == [dt.date(2024, 1, 21)]


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "profile")
    schema = "user_id long, category_slug string, ts timestamp, weight double"
    first = spark.createDataFrame([(u, c, at(60 * u), 1.0 + u) for u in range(40) for c in ("a", "b")], schema)
    second = spark.createDataFrame([(1, "a", at(9000), 2.0), (99, "z", at(4000), 3.0), (1, "a", None, 2.0)], schema)
    S.fold_profile(first, 0, path)
    S.fold_profile(second, 1, path)

    def state():
        return sorted((r.user_id, r.category_slug, round(r.affinity, 9)) for r in S.profile_at(S.read_store(spark, path), F.lit(at(10000)).cast("timestamp")).collect())

    def files():
        return {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    want = {}
    for u, c, t, w in [tuple(r) for r in first.union(second).collect()]:
        if t is not None:
            want[u, c] = want.get((u, c), 0) + w * 0.5 ** ((at(10000) - t).total_seconds() / 86400 / 3)
    once, before = state(), files()
    assert once == sorted((u, c, round(v, 9)) for (u, c), v in want.items())
    S.fold_profile(second, 1, path)
    assert state() == once
    S.fold_profile(spark.createDataFrame([(1, "a", at(9500), 1.0)], schema), 2, path)
    after = files()
    assert len(set(before) & set(after)) >= len(before) - 2, "buckets that the batch did not touch were written again"
    assert len(state()) == len(once) and state() != once


def test_health_store_replays_the_rule(spark, tmp_path):
    """The reference's cases: two successes; one error; one success and five errors."""
    path, sources = str(tmp_path / "health"), spark.createDataFrame([("A",), ("B",), ("C",)], "source_name string")
    rows = [(1, at(1), "A", "success", None), (2, at(2), "A", "success", None), (3, at(3), "B", "error", "boom"), (4, at(4), "C", "success", None),
            *((5 + i, at(5 + i), "C", "error", f"e{i}") for i in range(5)), (20, at(20), "X", "error", "unknown")]
    schema = "seq long, ts timestamp, source_name string, status string, error string"
    for n in range(3):
        S.fold_health(spark.createDataFrame(rows[n::3], schema), n, path, sources)
        S.fold_health(spark.createDataFrame(rows[n::3], schema), n, path, sources)
    got = {r.source_key: (r.success_count, r.error_count, r.last_error, r.is_healthy) for r in S.health_of(S.read_store(spark, path)).collect()}
    assert got == {"a": (2, 0, None, True), "b": (0, 1, "boom", False), "c": (1, 5, "e4", False)}


def test_articles_are_upserted_and_bad_rows_set_aside(spark, tmp_path):
    path, bad = str(tmp_path / "articles"), str(tmp_path / "bad")
    schema = "canonical_url string, page_id long, html_chars int"
    S.fold_articles(spark.createDataFrame([("u", 1, 5), ("v", 2, 5), (None, 3, 5), ("w", 4, None)], schema), 0, path, bad,
                    valid=F.col("html_chars") > 0)
    S.fold_articles(spark.createDataFrame([("u", 9, 7), ("u", 8, 6), ("v", 1, 9)], schema), 1, path, bad)
    got = sorted((r.canonical_url, r.page_id, r.html_chars) for r in S.read_store(spark, path).collect())
    assert got == [("u", 9, 7), ("v", 2, 5)]
    assert sorted(r.page_id for r in spark.read.parquet(bad).collect()) == [3, 4]
