"""Registered queries: users, preferences, comments and bookmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import interactions as I
from inkwell.operators import users as U
from inkwell.plans.catalog import query
from inkwell.plans.oracle_views import with_views
from inkwell.sources import fixtures as fx


def _existing_users(spark, sf):
    # Stored users: those with a preference row, email known, no Google id yet.
    p = fx.preferences(spark, sf).select("user_id")
    return p.select("user_id", F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@mail.test")).alias("email"),
                    F.lit(None).cast("string").alias("google_id"), F.lit("reader").alias("role"),
                    F.lit(None).cast("timestamp_ntz").alias("last_login_at"))


def _logins(spark, sf):
    ev = fx.interactions(spark, sf).where(F.col("interaction_type") == "bookmark")
    return ev.select(F.col("ts").alias("login_ts"),
                     F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("google_id"),
                     F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@mail.test")).alias("email"))


@query("f1_resolve_users", with_views("""
WITH ex AS (SELECT user_id, 'user' || CAST(user_id AS VARCHAR) || '@mail.test' AS email, CAST(NULL AS VARCHAR) AS google_id,
  'reader' AS role, CAST(NULL AS TIMESTAMP) AS last_login_at FROM preferences),
lg AS (SELECT ts AS login_ts, 'g' || CAST(user_id AS VARCHAR) AS google_id, 'user' || CAST(user_id AS VARCHAR) || '@mail.test' AS email
  FROM interactions WHERE interaction_type = 'bookmark'),
l1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY google_id ORDER BY login_ts DESC, email) AS r FROM lg) WHERE r = 1),
linked AS (SELECT ex.user_id, l1.login_ts, l1.google_id FROM l1 JOIN ex ON ex.email = l1.email),
fresh AS (SELECT * FROM l1 WHERE email NOT IN (SELECT email FROM ex)),
mx AS (SELECT max(user_id) AS m FROM ex)
SELECT ex.user_id, ex.email, coalesce(linked.google_id, ex.google_id) AS google_id, ex.role,
  greatest(ex.last_login_at, linked.login_ts) AS last_login_at FROM ex LEFT JOIN linked USING (user_id)
UNION ALL
SELECT CAST((SELECT m FROM mx) + row_number() OVER (ORDER BY login_ts, google_id) AS BIGINT), email, google_id, 'reader', login_ts FROM fresh
""", "preferences", "interactions"))
def f1_resolve_users(spark, sf):
    return U.resolve_users(_logins(spark, sf), _existing_users(spark, sf))


def _onboarding_requests(spark, sf):
    # One request per user: the categories of the articles they bookmarked.
    ev = fx.interactions(spark, sf).where(F.col("interaction_type") == "bookmark")
    a = fx.articles(spark, sf).select(F.col("article_id").alias("item_id"), "category_slug")
    u = fx.users(spark, sf)
    r = ev.join(a, "item_id").groupBy("user_id").agg(
        F.array_sort(F.collect_set("category_slug")).alias("categories"), F.max("ts").alias("ts"))
    return r.join(u, "user_id").select("user_id", "categories", F.array("language").alias("languages"), "ts")


_REQ = """req AS (SELECT e.user_id, list_sort(list_distinct(list(a.category_slug))) AS categories, max(e.ts) AS ts
  FROM interactions e JOIN articles a ON a.article_id = e.item_id WHERE e.interaction_type = 'bookmark' GROUP BY e.user_id),
good AS (SELECT req.user_id, array_to_string(categories, ',') AS cats, u.language AS langs FROM req JOIN users u USING (user_id)
  WHERE len(categories) >= 3)"""


@query("f2_apply_onboarding", with_views(f"""WITH {_REQ}
SELECT coalesce(p.user_id, g.user_id) AS user_id, coalesce(g.langs, p.preferred_languages) AS preferred_languages,
  coalesce(g.cats, p.preferred_categories) AS preferred_categories, coalesce(p.notification_enabled, true) AS notification_enabled
FROM preferences p FULL OUTER JOIN good g ON p.user_id = g.user_id
""", "interactions", "articles", "users", "preferences"))
def f2_apply_onboarding(spark, sf):
    out, _ = U.apply_onboarding(_onboarding_requests(spark, sf), fx.preferences(spark, sf))
    return out


_CATS = fx.CATEGORY_SLUGS


@query("f3_apply_patches", with_views("""
WITH c AS (SELECT [""" + ",".join(f"'{x}'" for x in _CATS) + """] AS cats),
r AS (SELECT user_id, ts + to_microseconds(event_id) AS ts, CASE WHEN event_id % 3 = 0 THEN
    cats[CAST(event_id % 15 + 1 AS INT):CAST(event_id % 15 + 2 + event_id % 4 AS INT)] END AS categories,
  CASE WHEN event_id % 8 = 5 THEN [] WHEN event_id % 4 = 1 THEN ['en', 'fr'] END AS languages,
  CASE WHEN event_id % 5 = 0 THEN event_id % 2 = 0 END AS notification_enabled
  FROM interactions, c WHERE interaction_type = 'share'),
good AS (SELECT * FROM r WHERE categories IS NULL OR len(categories) >= 3),
l AS (SELECT user_id, arg_max(array_to_string(categories, ','), CASE WHEN categories IS NOT NULL THEN ts END) AS cats,
  arg_max(array_to_string(languages, ','), CASE WHEN languages IS NOT NULL THEN ts END) AS langs,
  arg_max(notification_enabled, CASE WHEN notification_enabled IS NOT NULL THEN ts END) AS notif FROM good GROUP BY user_id)
SELECT coalesce(p.user_id, l.user_id) AS user_id, coalesce(l.langs, p.preferred_languages, 'en') AS preferred_languages,
  coalesce(l.cats, p.preferred_categories) AS preferred_categories, coalesce(l.notif, p.notification_enabled, true) AS notification_enabled,
  coalesce(b.n, 0) AS rejected
FROM preferences p FULL OUTER JOIN l ON l.user_id = p.user_id
LEFT JOIN (SELECT user_id, count(*) AS n FROM r WHERE len(categories) < 3 GROUP BY user_id) b ON b.user_id = coalesce(p.user_id, l.user_id)
""", "interactions", "preferences"))
def f3_apply_patches(spark, sf):
    """Every share stands for a patch of some fields; some list too few categories and are rejected whole."""
    n = F.col("event_id")
    cats = F.slice(F.array(*map(F.lit, _CATS)), (n % 15 + 1).cast("int"), (n % 4 + 2).cast("int"))
    patches = fx.interactions(spark, sf).where("interaction_type = 'share'").select(
        "user_id", F.expr("timestampadd(MICROSECOND, cast(event_id as int), ts)").alias("ts"), F.when(n % 3 == 0, cats).alias("categories"),
        F.when(n % 8 == 5, F.array().cast("array<string>")).when(n % 4 == 1, F.array(F.lit("en"), F.lit("fr"))).alias("languages"),
        F.when(n % 5 == 0, n % 2 == 0).alias("notification_enabled"))
    out, bad = U.apply_patches(patches, fx.preferences(spark, sf))
    count = bad.groupBy("user_id").agg(F.count("*").alias("rejected"))
    return out.join(count, "user_id", "left").fillna(0, ["rejected"])


@query("f4_user_profile", with_views("""
SELECT u.user_id, u.language, p.preferred_languages, p.preferred_categories, p.notification_enabled, p.user_id IS NULL AS needs_onboarding
FROM users u LEFT JOIN preferences p USING (user_id)
""", "users", "preferences"))
def f4_user_profile(spark, sf):
    return U.user_profile(fx.users(spark, sf), fx.preferences(spark, sf))


@query("f5_explode_prefs", with_views("""
SELECT DISTINCT user_id, 'category' AS kind, trim(unnest(string_split(preferred_categories, ','))) AS value FROM preferences
UNION SELECT DISTINCT user_id, 'language', trim(unnest(string_split(preferred_languages, ','))) FROM preferences
""", "preferences"))
def f5_explode_prefs(spark, sf):
    return U.explode_prefs(fx.preferences(spark, sf))


@query("f8_comment_threads", with_views("""
WITH RECURSIVE t(comment_id, item_id, parent_id, root_id, depth, path) AS (
  SELECT comment_id, item_id, parent_id, comment_id, 0, CAST(comment_id AS VARCHAR) FROM comments WHERE parent_id IS NULL
  UNION ALL
  SELECT c.comment_id, c.item_id, c.parent_id, t.root_id, t.depth + 1, t.path || '/' || CAST(c.comment_id AS VARCHAR)
  FROM comments c JOIN t ON c.parent_id = t.comment_id),
r AS (SELECT parent_id AS comment_id, count(*) AS n FROM t WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT t.comment_id, t.item_id, t.parent_id, t.root_id, t.depth, t.path, CAST(coalesce(r.n, 0) AS BIGINT) AS reply_count
FROM t LEFT JOIN r USING (comment_id)
""", "comments"))
def f8_comment_threads(spark, sf):
    return U.comment_threads(fx.comments(spark, sf))


@query("f11_bookmarks", with_views("""
WITH st AS (SELECT user_id, item_id, action, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) AS rn,
  max(ts) OVER (PARTITION BY user_id, item_id) AS last_ts FROM ievents WHERE action IN ('bookmark', 'unbookmark')) WHERE rn = 1)
SELECT s.item_id, s.user_id, s.ts AS last_ts, a.title,
  row_number() OVER (PARTITION BY s.user_id ORDER BY s.ts DESC, s.item_id) AS position
FROM st s JOIN articles a ON a.article_id = s.item_id WHERE s.action = 'bookmark'
""", "ievents", "articles"))
def f11_bookmarks(spark, sf):
    st = I.toggle_state(fx.interaction_events(spark, sf))
    return U.bookmarks(st, fx.articles(spark, sf))
