"""Registered queries: streaming jobs run with trigger(availableNow) over the driver tables, replayed slice of
time by slice of time; each result is read back from the job's sink and must equal the batch definition."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from inkwell.functions.text import canonical_url
from inkwell.operators import interactions as I
from inkwell.plans import duck_exprs as D
from inkwell.plans import q_engagement, q_recommend, q_registry  # noqa: F401 - their SQL is that of L5, L7 and L8
from inkwell.plans.catalog import ORACLE, query, r6
from inkwell.plans.oracle_views import with_views
from inkwell.sources import fixtures as fx
from inkwell.sources.tables import read_table
from inkwell.streaming import jobs as L
from inkwell.streaming import keyed as K
from inkwell.streaming import stores as S


def _replay(spark, df, name, order_col, job, session=None):
    """Replay ``df`` through ``job(stream)`` into a Parquet sink and read that."""
    base = L.work_dir(spark, name)
    src, out, ckpt = (os.path.join(base, p) for p in ("in", "out", "ckpt"))
    own = session or spark
    L.replay({src: (df, order_col)}, lambda: L.run_available_now(job(L.file_stream(own, src, df.schema)), out, ckpt))
    return spark.read.parquet(out)


def _utc(ts="ts"):
    return F.col(ts).cast("timestamp").alias(ts)


def _events(spark, sf):
    return fx.interaction_events(spark, sf).select("event_id", _utc(), "user_id", "item_id", "interaction_type", "action",
                                                   "time_spent_seconds")


@query("l2_stream_velocity", with_views("""
WITH ev AS (SELECT item_id, ts FROM interactions),
w AS (SELECT item_id, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * i) AS window_start FROM ev, range(12) r(i)),
c AS (SELECT item_id, window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS interactions FROM w
  GROUP BY item_id, window_start)
SELECT * FROM c WHERE window_end <= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE
""", "interactions"))
def l2_stream_velocity(spark, sf):
    ev = fx.interactions(spark, sf).select("event_id", _utc(), "item_id")
    r = _replay(spark, ev, "velocity", "ts", L.stream_velocity)
    return r.select("item_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "interactions")


@query("l9_stream_throughput", with_views("""
SELECT date_trunc('hour', ts) AS hour, status, count(*) AS n FROM scrape_log
GROUP BY date_trunc('hour', ts), status
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM scrape_log) - INTERVAL 10 MINUTE
""", "scrape_log"))
def l9_stream_throughput(spark, sf):
    log = fx.scrape_log(spark, sf).select("seq", _utc(), "status")
    r = _replay(spark, log, "throughput", "ts", L.stream_throughput)
    return r.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "status", "n")


@query("l1_stream_ingest", f"""
WITH p AS (SELECT page_id, url, {D.canonical_url('url')} AS canonical_url, length(html) AS html_chars FROM pages)
SELECT canonical_url, page_id, url, html_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY page_id DESC) AS rn FROM p) WHERE rn = 1
""")
def l1_stream_ingest(spark, sf):
    pages = read_table(spark, sf, "pages").select(
        "page_id", "url", canonical_url("url").alias("canonical_url"), F.length("html").alias("html_chars"))
    base = L.work_dir(spark, "ingest")
    src, store, rejects, ckpt = (os.path.join(base, p) for p in ("in", "store", "rejects", "ckpt"))
    L.replay({src: (pages, "page_id")}, lambda: S.stream_into(
        L.file_stream(spark, src, pages.schema), ckpt, lambda rows, n: S.fold_articles(rows, n, store, rejects)))
    return S.read_store(spark, store).select("canonical_url", "page_id", "url", "html_chars")


@query("l3_stream_dedup")
def l3_stream_dedup(spark, sf):
    """Rows-only: repeated (user, item, type) interactions within 48 h dropped,
    first arrival kept (repeats beyond the delay may survive)."""
    ev = fx.interactions(spark, sf).select("event_id", _utc(), "user_id", "item_id", "interaction_type")
    return _replay(spark, ev, "dedup", "ts", lambda s: L.stream_dedup(s, ["user_id", "item_id", "interaction_type"]))


@query("l4_stream_breaking", with_views("""
WITH wm AS (SELECT least((SELECT max(publish_time) FROM articles), (SELECT max(ts) FROM interactions)) - INTERVAL 10 MINUTE AS w),
c AS (SELECT article_id, language, category_slug, publish_time, count(*) AS interactions FROM articles
  JOIN interactions ON item_id = article_id AND ts > publish_time AND ts <= publish_time + INTERVAL 1440 MINUTE
  GROUP BY article_id, language, category_slug, publish_time)
SELECT article_id, language, category_slug, publish_time, interactions, round(interactions / 1440.0, 6) AS velocity
FROM c WHERE interactions / 1440.0 > 0.0015 AND publish_time <= (SELECT w FROM wm) - INTERVAL 1440 MINUTE
""", "articles", "interactions"))
def l4_stream_breaking(spark, sf):
    """A day after publication, as few articles have interactions; more than two of them break."""
    base = L.work_dir(spark, "breaking")
    at = {name: os.path.join(base, name) for name in ("articles", "events", "out", "ckpt")}
    articles = fx.articles(spark, sf).select("article_id", "language", "category_slug", _utc("publish_time"))
    events = fx.interactions(spark, sf).select("item_id", _utc())

    def drain():
        job = L.stream_breaking(L.file_stream(spark, at["articles"], articles.schema), L.file_stream(spark, at["events"], events.schema),
                                threshold=0.0015, minutes=24 * 60)
        L.run_available_now(job, at["out"], at["ckpt"])

    L.replay({at["articles"]: (articles, "publish_time"), at["events"]: (events, "ts")}, drain)
    return spark.read.parquet(at["out"]).withColumn("publish_time", F.col("publish_time").cast("timestamp_ntz")).withColumn(
        "velocity", r6("velocity"))


def _changes(spark, sf):
    """Events replayed with one in five of them sent twice."""
    ev = _events(spark, sf)
    twice = ev.unionByName(ev.where("event_id % 5 = 0"))
    return _replay(spark, twice, "state", "ts", K.stream_state, K.keyed_session(spark))


@query("l5_live_counts", ORACLE["f7_interaction_counts"])
def l5_live_counts(spark, sf):
    return K.live_counts(_changes(spark, sf))


@query("l5_live_toggles", ORACLE["f6_toggle_state"])
def l5_live_toggles(spark, sf):
    return K.live_toggles(_changes(spark, sf)).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query("l6_stream_limit_comments", with_views("""
SELECT user_id, CAST(ts AS DATE) AS day, event_id, item_id, ts, day_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS day_rank
  FROM interactions WHERE interaction_type = 'comment') WHERE day_rank <= 2
""", "interactions"))
def l6_stream_limit_comments(spark, sf):
    """Two a day, as users write few comments."""
    ev = fx.interactions(spark, sf).select("event_id", _utc(), "user_id", "item_id", "interaction_type")
    r = _replay(spark, ev, "comments", "ts", lambda s: K.stream_limit_comments(s, 2), K.keyed_session(spark))
    return r.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("l7_stream_profile", ORACLE["h2_user_profile_vector"])
def l7_stream_profile(spark, sf):
    items = fx.articles(spark, sf).select(F.col("article_id").alias("item_id"), "category_slug")
    signals = I.weighted_signals(fx.interaction_events(spark, sf)).join(items, "item_id").select(
        "user_id", "category_slug", _utc(), "weight")
    base = L.work_dir(spark, "profile")
    src, store, ckpt = (os.path.join(base, p) for p in ("in", "store", "ckpt"))
    L.replay({src: (signals, "ts")}, lambda: S.stream_into(
        L.file_stream(spark, src, signals.schema), ckpt, lambda rows, n: S.fold_profile(rows, n, store)))
    as_of = fx.as_of_lit().cast("timestamp")
    return S.profile_at(S.read_store(spark, store), as_of).withColumn("affinity", r6("affinity"))


@query("l8_stream_health", ORACLE["a6_source_health"])
def l8_stream_health(spark, sf):
    log, sources = fx.scrape_log(spark, sf), fx.sources(spark, sf)
    base = L.work_dir(spark, "health")
    src, store, ckpt = (os.path.join(base, p) for p in ("in", "store", "ckpt"))
    log = log.withColumn("ts", _utc())
    L.replay({src: (log, "ts")}, lambda: S.stream_into(
        L.file_stream(spark, src, log.schema), ckpt, lambda rows, n: S.fold_health(rows, n, store, sources)))
    health = S.health_of(S.read_store(spark, store))
    for c in ("last_scrape_time", "last_error_time"):
        health = health.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return health.withColumn("success_rate", r6("success_rate"))
