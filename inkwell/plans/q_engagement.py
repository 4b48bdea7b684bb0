"""Registered queries: interactions (F6-F14, H1) and trending/explore."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import interactions as I
from inkwell.operators import trending as G
from inkwell.plans.catalog import query, r6
from inkwell.plans.oracle_views import with_views
from inkwell.sources import fixtures as fx

AS_OF = fx.AS_OF
TS = "TIMESTAMP '2024-01-31 00:00:00'"


# ---------------------------------------------------------------- G1 / G2
@query("g1_velocity", with_views(f"""
SELECT item_id, count(*) AS interactions, round(count(*) / 60.0, 6) AS velocity
FROM interactions WHERE ts > {TS} - INTERVAL 60 MINUTE AND ts <= {TS} GROUP BY item_id
""", "interactions"))
def g1_velocity(spark, sf):
    v = G.velocity(fx.interactions(spark, sf), AS_OF, minutes=60)
    return v.select("item_id", "interactions", r6("velocity").alias("velocity"))


def trending_24h(spark, sf, k=10):
    v = G.velocity(fx.interactions(spark, sf), AS_OF, minutes=24 * 60)
    t = G.trending(v, fx.articles(spark, sf), k)
    return t.select("language", "rank", "article_id", "title", "category_slug", "interactions",
                    r6("velocity").alias("velocity"))


_TRENDING_SQL = f"""
WITH v AS (SELECT item_id, count(*) AS interactions, count(*) / 1440.0 AS velocity FROM interactions
  WHERE ts > {TS} - INTERVAL 1440 MINUTE AND ts <= {TS} GROUP BY item_id),
j AS (SELECT a.article_id, a.language, a.title, a.category_slug, v.interactions, v.velocity,
  row_number() OVER (PARTITION BY a.language ORDER BY v.velocity DESC, a.article_id) AS rank
  FROM v JOIN articles a ON v.item_id = a.article_id)
SELECT language, rank, article_id, title, category_slug, interactions, round(velocity, 6) AS velocity
FROM j WHERE rank <= 10
"""


@query("g2_trending", with_views(_TRENDING_SQL, "articles", "interactions"))
def g2_trending(spark, sf):
    return trending_24h(spark, sf)


# ---------------------------------------------------------------- G3 / G4 / G5 / G6
@query("g3_category_counts", with_views("""
SELECT c.category_slug, c.display_order, CAST(count(a.article_id) AS BIGINT) AS article_count
FROM categories c LEFT JOIN (SELECT * FROM articles WHERE language = 'en') a ON a.category_slug = c.category_slug
GROUP BY c.category_slug, c.display_order
""", "categories", "articles"))
def g3_category_counts(spark, sf):
    return G.category_counts(fx.categories(spark), fx.articles(spark, sf), "en")


_TOPCAT = f"""
WITH recent AS (SELECT article_id, language, category_slug, publish_time FROM articles
  WHERE publish_time > {TS} - INTERVAL 24 HOUR AND publish_time <= {TS}),
hits AS (SELECT item_id, count(*) AS n FROM interactions WHERE ts > {TS} - INTERVAL 24 HOUR AND ts <= {TS} GROUP BY item_id),
j AS (SELECT r.*, coalesce(h.n, 0) AS interactions,
  row_number() OVER (PARTITION BY language, category_slug ORDER BY coalesce(h.n, 0) DESC, publish_time DESC, article_id) AS rank
  FROM recent r LEFT JOIN hits h ON r.article_id = h.item_id)
SELECT article_id, language, category_slug, publish_time, interactions, rank FROM j WHERE rank <= 5
"""


@query("g4_top_per_category", with_views(_TOPCAT, "articles", "interactions"))
def g4_top_per_category(spark, sf):
    return G.top_per_category(fx.articles(spark, sf), fx.interactions(spark, sf), AS_OF, k=5, hours=24)


_BREAKING = f"""
WITH v AS (SELECT item_id, count(*) AS interactions, count(*) / 1440.0 AS velocity FROM interactions
  WHERE ts > {TS} - INTERVAL 1440 MINUTE AND ts <= {TS} GROUP BY item_id)
SELECT a.article_id, a.language, a.title, a.category_slug, a.publish_time, v.interactions,
  round(v.velocity, 6) AS velocity, CAST(date_diff('second', a.publish_time, {TS}) AS BIGINT) AS age_seconds
FROM articles a JOIN v ON a.article_id = v.item_id
WHERE a.publish_time > {TS} - INTERVAL 10080 MINUTE AND a.publish_time <= {TS} AND v.velocity > 0.0
"""


def breaking_7d(spark, sf):
    # FIXTURES.md: breaking-news checks widen the age limit to 7 days (only a few
    # articles receive interactions); velocity over the last 24 hours.
    v = G.velocity(fx.interactions(spark, sf), AS_OF, minutes=24 * 60)
    return G.breaking(fx.articles(spark, sf), v, AS_OF, threshold=0.0, minutes=7 * 24 * 60)


@query("g5_breaking", with_views(_BREAKING, "articles", "interactions"))
def g5_breaking(spark, sf):
    b = breaking_7d(spark, sf)
    return b.select("article_id", "language", "title", "category_slug", "publish_time", "interactions",
                    r6("velocity").alias("velocity"), "age_seconds")


_EXPLORE = f"""
WITH v AS (SELECT item_id, count(*) AS interactions, count(*) / 1440.0 AS velocity FROM interactions
  WHERE ts > {TS} - INTERVAL 1440 MINUTE AND ts <= {TS} GROUP BY item_id),
b AS (SELECT a.article_id, a.language, 'breaking' AS section, 1 AS section_order,
   row_number() OVER (PARTITION BY a.language ORDER BY v.velocity DESC, a.article_id) AS section_rank
  FROM articles a JOIN v ON a.article_id = v.item_id
  WHERE a.publish_time > {TS} - INTERVAL 10080 MINUTE AND a.publish_time <= {TS} AND v.velocity > 0.0),
t AS (SELECT * FROM (SELECT a.article_id, a.language, 'trending' AS section, 2 AS section_order,
   row_number() OVER (PARTITION BY a.language ORDER BY v.velocity DESC, a.article_id) AS section_rank
  FROM v JOIN articles a ON v.item_id = a.article_id) WHERE section_rank <= 10),
tc AS ({_TOPCAT.replace("SELECT article_id, language, category_slug, publish_time, interactions, rank FROM j WHERE rank <= 5",
                        "SELECT article_id, language, 'category' AS section, 3 AS section_order, rank AS section_rank FROM j WHERE rank <= 5")}),
u AS (SELECT * FROM b UNION ALL SELECT * FROM t UNION ALL SELECT * FROM tc)
SELECT article_id, language, section, section_order, section_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY section_order, section_rank) AS f FROM u) WHERE f = 1
"""


@query("g6_explore", with_views(_EXPLORE, "articles", "interactions"))
def g6_explore(spark, sf):
    b = breaking_7d(spark, sf)
    v = G.velocity(fx.interactions(spark, sf), AS_OF, minutes=24 * 60)
    t = G.trending(v, fx.articles(spark, sf), 10)
    c = G.top_per_category(fx.articles(spark, sf), fx.interactions(spark, sf), AS_OF, k=5, hours=24)
    return G.explore(b, t, c)


# ---------------------------------------------------------------- F6..F14, H1
@query("f6_toggle_state", with_views("""
SELECT user_id, item_id, kind, last_action IN ('like', 'bookmark') AS active, last_ts FROM (
  SELECT user_id, item_id, kind, action AS last_action, max(ts) OVER (PARTITION BY user_id, item_id, kind) AS last_ts,
    row_number() OVER (PARTITION BY user_id, item_id, kind ORDER BY ts DESC, event_id DESC) AS rn
  FROM (SELECT *, CASE WHEN action IN ('like','unlike') THEN 'like' WHEN action IN ('bookmark','unbookmark') THEN 'bookmark' END AS kind
        FROM ievents) WHERE kind IS NOT NULL) WHERE rn = 1
""", "ievents"))
def f6_toggle_state(spark, sf):
    return I.toggle_state(fx.interaction_events(spark, sf))


@query("f7_interaction_counts", with_views("""
WITH base AS (SELECT item_id, count(*) FILTER (WHERE interaction_type = 'read') AS reads,
    count(*) FILTER (WHERE interaction_type = 'comment') AS comments,
    count(*) FILTER (WHERE interaction_type = 'share') AS shares FROM ievents GROUP BY item_id),
st AS (SELECT user_id, item_id, kind, action AS last_action FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, item_id, kind ORDER BY ts DESC, event_id DESC) AS rn FROM (
      SELECT *, CASE WHEN action IN ('like','unlike') THEN 'like' WHEN action IN ('bookmark','unbookmark') THEN 'bookmark' END AS kind
      FROM ievents) WHERE kind IS NOT NULL) WHERE rn = 1),
tg AS (SELECT item_id, count(*) FILTER (WHERE kind = 'like') AS likes, count(*) FILTER (WHERE kind = 'bookmark') AS bookmarks
    FROM st WHERE last_action IN ('like', 'bookmark') GROUP BY item_id)
SELECT coalesce(base.item_id, tg.item_id) AS item_id, CAST(coalesce(reads, 0) AS BIGINT) AS reads,
  CAST(coalesce(likes, 0) AS BIGINT) AS likes, CAST(coalesce(comments, 0) AS BIGINT) AS comments,
  CAST(coalesce(shares, 0) AS BIGINT) AS shares, CAST(coalesce(bookmarks, 0) AS BIGINT) AS bookmarks
FROM base FULL OUTER JOIN tg ON base.item_id = tg.item_id
""", "ievents"))
def f7_interaction_counts(spark, sf):
    return I.interaction_counts(fx.interaction_events(spark, sf))


@query("f9_limit_comments", with_views("""
SELECT * FROM (SELECT event_id, ts, user_id, item_id, interaction_type, time_spent_seconds, action,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS day_rank, CAST(ts AS DATE) AS day
  FROM ievents WHERE interaction_type = 'comment') WHERE day_rank <= 100
""", "ievents"))
def f9_limit_comments(spark, sf):
    return I.limit_comments(fx.interaction_events(spark, sf), n=100)


@query("f10_read_stats", with_views("""
SELECT user_id, item_id, count(*) AS opens, round(sum(time_spent_seconds), 6) AS total_time,
  round(avg(time_spent_seconds), 6) AS avg_time
FROM interactions WHERE interaction_type = 'read' GROUP BY user_id, item_id
""", "interactions"))
def f10_read_stats(spark, sf):
    r = I.read_stats(fx.interaction_events(spark, sf))
    return r.select("user_id", "item_id", "opens", r6("total_time").alias("total_time"),
                    r6("avg_time").alias("avg_time"))


@query("f12_reading_history", with_views(f"""
SELECT user_id, item_id, last_viewed,
  row_number() OVER (PARTITION BY user_id ORDER BY last_viewed DESC, item_id) AS position
FROM (SELECT user_id, item_id, max(ts) AS last_viewed FROM interactions
  WHERE interaction_type = 'read' AND ts > {TS} - INTERVAL 7 DAY AND ts <= {TS} GROUP BY user_id, item_id)
""", "interactions"))
def f12_reading_history(spark, sf):
    return I.reading_history(fx.interaction_events(spark, sf), AS_OF, days=7)


@query("f13_user_stats", with_views(f"""
WITH ev AS (SELECT * FROM ievents WHERE ts <= {TS}),
c AS (SELECT user_id, count(DISTINCT CASE WHEN interaction_type = 'read' THEN item_id END) AS articles_read,
   count(*) FILTER (WHERE action = 'like') AS likes FROM ev GROUP BY user_id),
d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM ev),
isl AS (SELECT user_id, grp, count(*) AS len, max(day) AS last_day FROM (
   SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS grp FROM d)
   GROUP BY user_id, grp),
s AS (SELECT user_id, max(len) AS longest_streak,
   coalesce(max(CASE WHEN last_day >= DATE '2024-01-31' - 1 THEN len END), 0) AS current_streak FROM isl GROUP BY user_id)
SELECT c.user_id, CAST(articles_read AS BIGINT) AS articles_read, CAST(likes AS BIGINT) AS likes,
  CAST(coalesce(current_streak, 0) AS BIGINT) AS current_streak, CAST(coalesce(longest_streak, 0) AS BIGINT) AS longest_streak
FROM c LEFT JOIN s ON c.user_id = s.user_id
""", "ievents"))
def f13_user_stats(spark, sf):
    return I.user_stats(fx.interaction_events(spark, sf), AS_OF)


_WEIGHT_SQL = """CASE WHEN interaction_type = 'read' THEN 1.0 + CASE WHEN coalesce(time_spent_seconds, 0.0) > 5.0 THEN 2.0 ELSE 0.0 END
  WHEN action = 'like' THEN 3.0 WHEN action = 'bookmark' THEN 4.0 WHEN interaction_type = 'comment' THEN 5.0
  WHEN interaction_type = 'share' THEN 7.0 ELSE 0.0 END"""


@query("f14_weighted_signals", with_views(f"""
SELECT event_id, ts, user_id, item_id, interaction_type, CAST({_WEIGHT_SQL} AS DOUBLE) AS weight FROM ievents
""", "ievents"))
def f14_weighted_signals(spark, sf):
    return I.weighted_signals(fx.interaction_events(spark, sf))


@query("h1_engagement_matrix", with_views(f"""
SELECT user_id, item_id, round(sum(CAST({_WEIGHT_SQL} AS DOUBLE)), 6) AS engagement, count(*) AS signals
FROM ievents GROUP BY user_id, item_id
""", "ievents"))
def h1_engagement_matrix(spark, sf):
    m = I.engagement_matrix(I.weighted_signals(fx.interaction_events(spark, sf)))
    return m.select("user_id", "item_id", r6("engagement").alias("engagement"), "signals")
