"""Registered queries: notifications (J1-J5) and retention/monitoring."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from inkwell.functions.text import canonical_url
from inkwell.functions.time import ts_lit
from inkwell.operators import interactions as I
from inkwell.operators import ops as O
from inkwell.operators import retention as R
from inkwell.operators import trending as G
from inkwell.operators.ingest import upsert_articles
from inkwell.plans import duck_exprs as D
from inkwell.plans.catalog import query, r6
from inkwell.plans.oracle_views import with_views
from inkwell.plans.q_engagement import _WEIGHT_SQL
from inkwell.plans.q_stories import _MEMBERS, _stories
from inkwell.sources import fixtures as fx
from inkwell.sources.tables import read_table

AS_OF = fx.AS_OF
PREV = "2024-01-30 12:00:00"
TS = "TIMESTAMP '2024-01-31 00:00:00'"
TSP = "TIMESTAMP '2024-01-30 12:00:00'"


def _breaking(spark, sf, as_of):
    v = G.velocity(fx.interactions(spark, sf), as_of, minutes=24 * 60)
    return G.breaking(fx.articles(spark, sf), v, as_of, threshold=0.0, minutes=7 * 24 * 60)


def _outbox(spark, sf):
    users = fx.users(spark, sf)
    sent = O.breaking_outbox(_breaking(spark, sf, PREV), users)
    return O.breaking_outbox(_breaking(spark, sf, AS_OF), users, sent)


def _brk_sql(name, ts):
    return f"""{name} AS (SELECT a.article_id, a.language, a.title FROM articles a JOIN (
  SELECT item_id, count(*) / 1440.0 AS velocity FROM interactions WHERE ts > {ts} - INTERVAL 1440 MINUTE AND ts <= {ts} GROUP BY item_id) v
  ON a.article_id = v.item_id WHERE a.publish_time > {ts} - INTERVAL 10080 MINUTE AND a.publish_time <= {ts} AND v.velocity > 0.0)"""


_OUTBOX = f"""{_brk_sql('bnow', TS)}, {_brk_sql('bprev', TSP)},
sent AS (SELECT u.user_id, b.article_id FROM users u JOIN bprev b ON b.language = u.language),
ob AS (SELECT u.user_id, b.article_id, b.title, 'breaking' AS notification_type FROM users u JOIN bnow b ON b.language = u.language
  WHERE NOT EXISTS (SELECT 1 FROM sent s WHERE s.user_id = u.user_id AND s.article_id = b.article_id)),
al AS (SELECT ob.* FROM ob LEFT JOIN preferences p USING (user_id) WHERE coalesce(p.notification_enabled, true))"""


@query("j1_breaking_outbox", with_views(f"WITH {_OUTBOX}\nSELECT * FROM ob", "articles", "interactions", "users", "preferences"))
def j1_breaking_outbox(spark, sf):
    return _outbox(spark, sf)


@query("j2_daily_digest", with_views(_MEMBERS + """,
top AS (SELECT * FROM (SELECT language, story_id, title, row_number() OVER (PARTITION BY language ORDER BY importance_score DESC, story_id) AS rank
  FROM st WHERE last_updated_at > TIMESTAMP '2024-01-29 02:30:00' AND last_updated_at <= TIMESTAMP '2024-01-30 02:30:00') WHERE rank <= 3)
SELECT u.user_id, u.language, top.story_id, top.title, top.rank FROM users u JOIN top ON top.language = u.language
""", "articles", "sources", "users"))
def j2_daily_digest(spark, sf):
    _, st = _stories(spark, sf)
    return O.daily_digest(st, fx.users(spark, sf), "2024-01-30", k=3)


@query("j3_allowed", with_views(f"WITH {_OUTBOX}\nSELECT * FROM al", "articles", "interactions", "users", "preferences"))
def j3_allowed(spark, sf):
    return O.allowed(_outbox(spark, sf), fx.preferences(spark, sf))


@query("j4_notification_history", with_views(f"""WITH {_OUTBOX},
notes AS (SELECT al.*, a.publish_time AS created_at,
  EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = al.user_id AND i.item_id = al.article_id AND i.interaction_type = 'read') AS is_read
  FROM al JOIN articles a USING (article_id)),
unread AS (SELECT user_id, count(*) FILTER (WHERE NOT is_read) AS unread_count FROM notes GROUP BY user_id)
SELECT * FROM (SELECT notes.*, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, article_id DESC) AS position FROM notes)
JOIN unread USING (user_id) WHERE position <= 10
""", "articles", "interactions", "users", "preferences"))
def j4_notification_history(spark, sf):
    al = O.allowed(_outbox(spark, sf), fx.preferences(spark, sf))
    a = fx.articles(spark, sf).select("article_id", F.col("publish_time").alias("created_at"))
    reads = (fx.interactions(spark, sf).where(F.col("interaction_type") == "read")
             .select("user_id", F.col("item_id").alias("article_id")).distinct().withColumn("_read", F.lit(True)))
    notes = (al.join(a, "article_id").join(reads, ["user_id", "article_id"], "left")
             .withColumn("is_read", F.coalesce("_read", F.lit(False))).drop("_read"))
    return O.notification_history(notes, n=10)


@query("j5_latest_tokens", with_views("""
SELECT user_id, token, registered_at FROM (SELECT user_id, md5('tok' || CAST(event_id AS VARCHAR)) AS token,
  max(ts) OVER (PARTITION BY user_id) AS registered_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM interactions WHERE interaction_type = 'bookmark') WHERE rn = 1
""", "interactions"))
def j5_latest_tokens(spark, sf):
    # Device registrations: the bookmark (signup) events, one token per event.
    ev = fx.interactions(spark, sf).where(F.col("interaction_type") == "bookmark").select(
        "user_id", "ts", "event_id", F.md5(F.concat(F.lit("tok"), F.col("event_id").cast("string"))).alias("token"))
    return O.latest_tokens(ev)


# ---------------------------------------------------------------- retention
@query("k1_archive", with_views(f"SELECT article_id, publish_time <= {TS} - INTERVAL 14 DAY AS archived FROM articles", "articles"))
def k1_archive(spark, sf):
    return O.archive(fx.articles(spark, sf), AS_OF, 14).select("article_id", "archived")


def _purge(spark, sf):
    return O.purge(fx.articles(spark, sf), fx.interactions(spark, sf), fx.comments(spark, sf), AS_OF, 21)


_DOOMED = f"doomed AS (SELECT article_id FROM articles WHERE publish_time <= {TS} - INTERVAL 21 DAY)"


@query("k2_purge", with_views(f"""WITH {_DOOMED}
SELECT 'articles' AS table_name, count(*) AS before, count(*) FILTER (WHERE article_id NOT IN (SELECT article_id FROM doomed)) AS kept,
  count(*) FILTER (WHERE article_id IN (SELECT article_id FROM doomed)) AS purged FROM articles
UNION ALL SELECT 'interactions', count(*), count(*) FILTER (WHERE item_id NOT IN (SELECT article_id FROM doomed)),
  count(*) FILTER (WHERE item_id IN (SELECT article_id FROM doomed)) FROM interactions
UNION ALL SELECT 'comments', count(*), count(*) FILTER (WHERE item_id NOT IN (SELECT article_id FROM doomed)),
  count(*) FILTER (WHERE item_id IN (SELECT article_id FROM doomed)) FROM comments
""", "articles", "interactions", "comments"))
def k2_purge(spark, sf):
    ka, ki, kc, _ = _purge(spark, sf)
    return O.purge_report([("articles", fx.articles(spark, sf), ka), ("interactions", fx.interactions(spark, sf), ki),
                           ("comments", fx.comments(spark, sf), kc)])


# Stories of one language, category and week, a snap for each article: the children that a deletion reaches.
_STORY_SQL = """st AS (SELECT *, coalesce(language, '') || '|' || category_slug || '|' || CAST(CAST(date_trunc('week', publish_time) AS DATE) AS VARCHAR)
  AS story_id FROM articles),
ds AS (SELECT story_id FROM st GROUP BY story_id HAVING min(publish_time) <= {cut}),
dn AS (SELECT source_name FROM sources WHERE reliability_score <= 0.5),
da AS (SELECT article_id FROM st WHERE publish_time <= {cut}),
dsnap AS (SELECT article_id AS snap_id FROM st WHERE story_id IN (FROM ds)),
dc AS (SELECT comment_id FROM comments WHERE item_id IN (FROM dsnap)
  UNION SELECT c.comment_id FROM comments c JOIN dc ON c.parent_id = dc.comment_id)"""


def _keyed(spark, sf):
    """The tables of the key graph and the ids that age or retirement deletes."""
    arts, src = fx.articles(spark, sf), fx.sources(spark, sf)
    week = F.date_trunc("week", "publish_time").cast("date").cast("string")
    a = arts.select("article_id", F.col("source_name").alias("source_id"), "publish_time", F.concat(
        F.coalesce("language", F.lit("")), F.lit("|"), "category_slug", F.lit("|"), week).alias("story_id"))
    stories = a.groupBy("story_id").agg(F.min("publish_time").alias("created_at"))
    tables = {
        "sources": src.select(F.col("source_name").alias("source_id"), "reliability_score"),
        "stories": stories, "articles": a, "snaps": a.select(F.col("article_id").alias("snap_id"), "story_id"),
        "interactions": fx.interactions(spark, sf).withColumnRenamed("item_id", "snap_id"),
        "comments": fx.comments(spark, sf).withColumnRenamed("item_id", "snap_id"),
    }
    ids = {"sources": "source_id", "stories": "story_id", "articles": "article_id", "snaps": "snap_id",
           "interactions": "event_id", "comments": "comment_id"}
    old = ts_lit(AS_OF, timedelta(days=21))
    doomed = {"articles": a.where(F.col("publish_time") <= old).select("article_id"),
              "stories": stories.where(F.col("created_at") <= old).select("story_id"),
              "sources": src.where(F.col("reliability_score") <= 0.5).select("source_name")}
    return tables, ids, doomed


@query("k2_cascade", with_views("WITH RECURSIVE " + _STORY_SQL.format(cut=f"{TS} - INTERVAL 21 DAY") + """,
n(table_name, before, kept, nulled) AS (
  SELECT 'sources', count(*), count(*) FILTER (WHERE source_name NOT IN (FROM dn)), 0 FROM sources
  UNION ALL SELECT 'stories', count(DISTINCT story_id), count(DISTINCT story_id) FILTER (WHERE story_id NOT IN (FROM ds)), 0 FROM st
  UNION ALL SELECT 'articles', count(*), count(*) FILTER (WHERE article_id NOT IN (FROM da)),
    count(*) FILTER (WHERE article_id NOT IN (FROM da) AND source_name IN (FROM dn))
    + count(*) FILTER (WHERE article_id NOT IN (FROM da) AND story_id IN (FROM ds)) FROM st
  UNION ALL SELECT 'snaps', count(*), count(*) FILTER (WHERE story_id NOT IN (FROM ds)), 0 FROM st
  UNION ALL SELECT 'interactions', count(*), count(*) FILTER (WHERE item_id IS NULL OR item_id NOT IN (FROM dsnap)), 0 FROM interactions
  UNION ALL SELECT 'comments', count(*), count(*) FILTER (WHERE comment_id NOT IN (FROM dc)), 0 FROM comments)
SELECT table_name, before, kept, before - kept AS purged, CAST(nulled AS BIGINT) AS nulled FROM n
""", "articles", "sources", "interactions", "comments"))
def k2_cascade(spark, sf):
    return R.cascade_report(R.cascade(*_keyed(spark, sf)))


@query("k3_preserve_aggregates", with_views(f"""WITH {_DOOMED}
SELECT e.user_id, a.category_slug, round(sum(CAST({_WEIGHT_SQL} AS DOUBLE)), 6) AS weight, count(*) AS signals
FROM ievents e JOIN articles a ON a.article_id = e.item_id WHERE e.item_id IN (SELECT article_id FROM doomed)
GROUP BY e.user_id, a.category_slug
""", "ievents", "articles"))
def k3_preserve_aggregates(spark, sf):
    *_, doomed = _purge(spark, sf)
    sig = I.weighted_signals(fx.interaction_events(spark, sf))
    agg = O.preserve_aggregates(sig, doomed, fx.articles(spark, sf))
    return agg.withColumn("weight", r6("weight"))


def _files(spark, sf):
    pages = read_table(spark, sf, "pages")
    files = pages.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"),
                         F.length("html").alias("bytes"))
    stored = upsert_articles(
        pages.select("page_id", canonical_url("url").alias("canonical_url")).withColumn("batch", F.lit(0)),
        pages.select("page_id", canonical_url("url").alias("canonical_url")).withColumn("batch", F.lit(0)),
        key="canonical_url", order_cols=["batch", "page_id"])
    ref = stored.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"))
    return files, ref


_ORPH = f"""orph AS (SELECT 'pages/' || CAST(page_id AS VARCHAR) AS path, length(html) AS bytes FROM pages
  WHERE page_id NOT IN (SELECT max(page_id) FROM pages GROUP BY {D.canonical_url('url')}))"""


@query("k4_orphans", f"WITH {_ORPH}\nSELECT path, bytes FROM orph")
def k4_orphans(spark, sf):
    files, ref = _files(spark, sf)
    return O.orphans(files, ref)


@query("k5_cleanup_report", with_views(f"""WITH {_DOOMED}, {_ORPH}
SELECT 'archive' AS item, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS bytes FROM articles WHERE publish_time <= {TS} - INTERVAL 14 DAY
UNION ALL SELECT 'purge', count(*), CAST(sum(length(content)) AS BIGINT) FROM articles WHERE article_id IN (SELECT article_id FROM doomed)
UNION ALL SELECT 'orphans', count(*), CAST(sum(bytes) AS BIGINT) FROM orph
""", "articles"))
def k5_cleanup_report(spark, sf):
    arts = fx.articles(spark, sf)
    arch = O.archive(arts, AS_OF, 14).where("archived")
    *_, doomed = _purge(spark, sf)
    purged = arts.join(doomed, "article_id", "left_semi")
    files, ref = _files(spark, sf)
    orph = O.orphans(files, ref)
    parts = [arch.agg(F.lit("archive").alias("item"), F.count("*").alias("n"), F.sum(F.length("content")).alias("bytes")),
             purged.agg(F.lit("purge").alias("item"), F.count("*").alias("n"), F.sum(F.length("content")).alias("bytes")),
             orph.agg(F.lit("orphans").alias("item"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("bytes", F.col("bytes").cast("bigint"))


@query("k6_throughput", with_views("""
SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (WHERE status = 'success') AS success,
  count(*) FILTER (WHERE status = 'error') AS error FROM scrape_log GROUP BY date_trunc('hour', ts)
""", "scrape_log"))
def k6_throughput(spark, sf):
    return O.throughput(fx.scrape_log(spark, sf))


@query("k7_content_stats", with_views("""
SELECT language, category_slug, count(*) AS articles, GROUPING(language, category_slug) AS level
FROM articles GROUP BY CUBE (language, category_slug)
""", "articles"))
def k7_content_stats(spark, sf):
    return O.content_stats(fx.articles(spark, sf))


@query("k8_recent_errors", with_views("""
SELECT seq, ts, source_name, status FROM scrape_log WHERE status = 'error' ORDER BY ts DESC, seq DESC LIMIT 100
""", "scrape_log"))
def k8_recent_errors(spark, sf):
    log = fx.scrape_log(spark, sf).where(F.col("status") == "error")
    return O.recent(log, [F.col("ts").desc(), F.col("seq").desc()], 100)


@query("k9_scrape_dashboard", with_views("""
SELECT source_name, date_trunc('hour', ts) AS hour, count(*) AS scrapes, count(*) FILTER (WHERE status = 'error') AS errors,
  round(count(*) FILTER (WHERE status = 'error') / count(*), 6) AS error_rate
FROM scrape_log GROUP BY ROLLUP (source_name, date_trunc('hour', ts))
""", "scrape_log"))
def k9_scrape_dashboard(spark, sf):
    return O.scrape_dashboard(fx.scrape_log(spark, sf)).withColumn("error_rate", r6("error_rate"))


@query("k9_ingest_dashboard", with_views("""
WITH f AS (SELECT *, date_trunc('hour', publish_time) AS hour, content IS NOT NULL AND content <> ''
  AND row_number() OVER (PARTITION BY content ORDER BY publish_time, article_id) > 1 AS again FROM articles),
c AS (SELECT source_name, hour, count(*) AS articles, count(*) FILTER (WHERE again) AS duplicates FROM f GROUP BY ALL),
l AS (SELECT source_name, date_trunc('hour', ts) AS hour, count(*) AS scrapes, count(*) FILTER (WHERE status = 'error') AS errors
  FROM scrape_log GROUP BY ALL),
k AS (SELECT source_name, hour FROM c UNION SELECT source_name, hour FROM l)
SELECT k.source_name, k.hour, CAST(coalesce(articles, 0) AS BIGINT) AS articles, CAST(coalesce(duplicates, 0) AS BIGINT) AS duplicates,
  CAST(coalesce(scrapes, 0) AS BIGINT) AS scrapes, CAST(coalesce(errors, 0) AS BIGINT) AS errors, round(errors / scrapes, 6) AS error_rate
FROM k LEFT JOIN c ON c.source_name IS NOT DISTINCT FROM k.source_name AND c.hour IS NOT DISTINCT FROM k.hour
LEFT JOIN l ON l.source_name IS NOT DISTINCT FROM k.source_name AND l.hour IS NOT DISTINCT FROM k.hour
""", "articles", "scrape_log"))
def k9_ingest_dashboard(spark, sf):
    return O.ingest_dashboard(fx.articles(spark, sf), fx.scrape_log(spark, sf)).withColumn("error_rate", r6("error_rate"))


@query("k10_recent_articles", with_views("""
SELECT article_id, title, publish_time FROM articles ORDER BY publish_time DESC, article_id DESC LIMIT 50
""", "articles"))
def k10_recent_articles(spark, sf):
    a = fx.articles(spark, sf).select("article_id", "title", "publish_time")
    return O.recent(a, [F.col("publish_time").desc(), F.col("article_id").desc()], 50)


@query("k11_integrity_report", with_views(f"""
SELECT 'interactions.item_id -> articles' AS constraint_name, count(*) AS violations FROM interactions
  WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT article_id FROM articles)
UNION ALL SELECT 'comments.parent_id -> comments', count(*) FROM comments
  WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT comment_id FROM comments)
UNION ALL SELECT 'preferences.user_id -> users', count(*) FROM preferences WHERE user_id NOT IN (SELECT user_id FROM users)
UNION ALL SELECT 'articles.url unique', count(*) FROM (SELECT {D.canonical_url('url')} AS u FROM pages GROUP BY u HAVING count(*) > 1)
UNION ALL SELECT 'sources.name unique', count(*) FROM (SELECT source_name FROM sources GROUP BY source_name HAVING count(*) > 1)
""", "interactions", "articles", "comments", "preferences", "users", "sources"))
def k11_integrity_report(spark, sf):
    pages = read_table(spark, sf, "pages").select(canonical_url("url").alias("canonical_url"))
    checks = [
        ("interactions.item_id -> articles", O.fk_violations(fx.interactions(spark, sf), "item_id", fx.articles(spark, sf), "article_id")),
        ("comments.parent_id -> comments", O.fk_violations(fx.comments(spark, sf), "parent_id", fx.comments(spark, sf), "comment_id")),
        ("preferences.user_id -> users", O.fk_violations(fx.preferences(spark, sf), "user_id", fx.users(spark, sf), "user_id")),
        ("articles.url unique", O.unique_violations(pages, "canonical_url")),
        ("sources.name unique", O.unique_violations(fx.sources(spark, sf), "source_name")),
    ]
    return O.integrity_report(checks)
