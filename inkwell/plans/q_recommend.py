"""Registered queries: recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import interactions as I
from inkwell.operators import recommend as H
from inkwell.operators import trending as G
from inkwell.plans.catalog import query, r6
from inkwell.plans.oracle_views import with_views
from inkwell.plans.q_engagement import _WEIGHT_SQL
from inkwell.sources import fixtures as fx

AS_OF = fx.AS_OF
STORED_AS_OF = "2024-01-24 00:00:00"
TS = "TIMESTAMP '2024-01-31 00:00:00'"
AGE = f"(epoch({TS}) - epoch(ts))"
EXPERIMENTS = [("feed_ranking", "control", 50), ("feed_ranking", "diverse", 30), ("feed_ranking", "trending_heavy", 20)]
# Per-variant configuration for the A/B test.
VARIANTS = [("feed_ranking", "control", 0.40, 0.35, 0.25, 0.2),
            ("feed_ranking", "diverse", 0.40, 0.35, 0.25, 0.3),
            ("feed_ranking", "trending_heavy", 0.30, 0.30, 0.40, 0.2)]


def _signals(spark, sf):
    return I.weighted_signals(fx.interaction_events(spark, sf))


def _items(spark, sf):
    return fx.articles(spark, sf).select("article_id", "category_slug", "language", "publish_time")


def _profile(spark, sf, as_of=AS_OF, since=None):
    s = _signals(spark, sf)
    if since is not None:
        s = s.where(F.col("ts") > F.lit(since).cast("timestamp_ntz"))
    return H.user_profile_vector(s, _items(spark, sf), as_of)


_SIG = f"sig AS (SELECT event_id, ts, user_id, item_id, interaction_type, action, CAST({_WEIGHT_SQL} AS DOUBLE) AS weight FROM ievents)"
_PROF = f"""prof AS (SELECT s.user_id, a.category_slug, sum(weight * pow(0.5, {AGE} / (86400.0 * 3.0))) AS affinity
  FROM sig s JOIN articles a ON a.article_id = s.item_id WHERE ts <= {TS} GROUP BY s.user_id, a.category_slug)"""


def _sql(body, *views):
    return with_views(f"WITH {_SIG},\n{_PROF},\n" + body.strip(), "ievents", "articles", *views)


@query("h2_user_profile_vector", _sql("SELECT user_id, category_slug, round(affinity, 6) AS affinity FROM prof"))
def h2_user_profile_vector(spark, sf):
    return _profile(spark, sf).withColumn("affinity", r6("affinity"))


_CAND = f"cand AS (SELECT article_id, category_slug FROM articles WHERE publish_time > {TS} - INTERVAL 24 HOUR AND publish_time <= {TS})"
_CS = """nrm AS (SELECT user_id, sqrt(sum(affinity * affinity)) AS n FROM prof GROUP BY user_id),
cs AS (SELECT p.user_id, c.article_id, c.category_slug, p.affinity / nrm.n AS content_score
  FROM prof p JOIN nrm USING (user_id) JOIN cand c ON c.category_slug = p.category_slug)"""


def _candidates(spark, sf, hours=24):
    a = _items(spark, sf)
    from inkwell.functions.time import in_window
    return a.where(in_window(F.col("publish_time"), AS_OF, hours * 3600))


@query("h3_content_scores", _sql(f"{_CAND},\n{_CS}\nSELECT user_id, article_id, category_slug, round(content_score, 6) AS content_score FROM cs"))
def h3_content_scores(spark, sf):
    return H.content_scores(_profile(spark, sf), _candidates(spark, sf), digits=6)


@query("h4_category_affinity", with_views("""
SELECT user_id, category_slug, count(DISTINCT CASE WHEN action IN ('like','bookmark','comment','share') THEN item_id END) AS engaged_items,
  count(DISTINCT CASE WHEN interaction_type = 'read' THEN item_id END) AS read_items,
  round(CASE WHEN count(DISTINCT CASE WHEN interaction_type = 'read' THEN item_id END) > 0 THEN
    count(DISTINCT CASE WHEN action IN ('like','bookmark','comment','share') THEN item_id END)
    / count(DISTINCT CASE WHEN interaction_type = 'read' THEN item_id END) END, 6) AS affinity
FROM ievents e JOIN articles a ON a.article_id = e.item_id GROUP BY user_id, category_slug
""", "ievents", "articles"))
def h4_category_affinity(spark, sf):
    a = H.category_affinity(fx.interaction_events(spark, sf), _items(spark, sf))
    return a.withColumn("affinity", r6("affinity"))


@query("h5_cold_start", with_views("""
SELECT u.user_id, CAST(coalesce(c.n, 0) AS BIGINT) AS interactions, p.user_id IS NOT NULL AS has_preferences,
  CASE WHEN coalesce(c.n, 0) < 20 THEN 'preferences' ELSE 'model' END AS route
FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM interactions GROUP BY user_id) c ON c.user_id = u.user_id
LEFT JOIN preferences p ON p.user_id = u.user_id
""", "users", "interactions", "preferences"))
def h5_cold_start(spark, sf):
    return H.cold_start(fx.users(spark, sf), fx.interactions(spark, sf), fx.preferences(spark, sf), n=20)


@query("h6_update_profile", _sql("SELECT user_id, category_slug, round(affinity, 6) AS affinity FROM prof"))
def h6_update_profile(spark, sf):
    # Stored profile as of a week earlier, then the last week's signals folded in.
    stored = _profile(spark, sf, as_of=STORED_AS_OF)
    new = _profile(spark, sf, as_of=AS_OF, since=STORED_AS_OF)
    u = H.update_profile(stored, STORED_AS_OF, new, AS_OF)
    return u.withColumn("affinity", r6("affinity"))


def _als(spark, sf):
    m = I.engagement_matrix(_signals(spark, sf))
    return m, H.train_als(m, rank=8, max_iter=8)


@query("h7_train_als")
def h7_train_als(spark, sf):
    """Rows-only: one row per user factor vector with its size and finiteness."""
    _, model = _als(spark, sf)
    uf = model.userFactors
    return uf.select(F.col("id").alias("user_id"), F.size("features").alias("rank"),
                     F.forall("features", lambda x: ~F.isnan(x)).alias("finite"))


def _als_recs(spark, sf, n=10):
    m, model = _als(spark, sf)
    return H.als_recommend(model, fx.users(spark, sf), m.select("user_id", "item_id"), n=n)


@query("h8_als_recommend")
def h8_als_recommend(spark, sf):
    """Rows-only: top-10 unseen ALS items per user."""
    return _als_recs(spark, sf).select("user_id", "item_id", "rank", r6("cf_score").alias("cf_score"))


def _velocity(spark, sf):
    return G.velocity(fx.interactions(spark, sf), AS_OF, minutes=24 * 60)


@query("h9_hybrid_score")
def h9_hybrid_score(spark, sf):
    """Rows-only (ALS part): content + collaborative + trending blend."""
    cf = _als_recs(spark, sf, n=20)
    # The ten fastest items of a user's language are candidates whatever the other scores say.
    top = G.trending(_velocity(spark, sf), fx.articles(spark, sf), 10).select("language", "article_id")
    offered = fx.users(spark, sf).join(F.broadcast(top), "language")  # ten rows a language
    return H.hybrid_over_categories(_profile(spark, sf), _candidates(spark, sf), cf, _velocity(spark, sf), offered, digits=6)


@query("h10_recency_factor", with_views(f"""
SELECT article_id, round(CASE WHEN a <= 4 THEN 1.2 WHEN a <= 24 THEN 1.0 ELSE pow(0.5, (a - 24) / 24.0) END, 6) AS recency
FROM (SELECT article_id, (epoch({TS}) - epoch(publish_time)) / 3600.0 AS a FROM articles)
""", "articles"))
def h10_recency_factor(spark, sf):
    a = fx.articles(spark, sf)
    return a.select("article_id", r6(H.recency_factor(F.col("publish_time"), AS_OF)).alias("recency"))


def _assign(spark, sf):
    return H.ab_assign(fx.users(spark, sf), EXPERIMENTS)


_ASSIGN = """asg AS (SELECT user_id, 'feed_ranking' AS experiment,
  CAST(('0x' || substr(md5('feed_ranking:' || CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS bucket FROM users),
asg2 AS (SELECT user_id, experiment, CASE WHEN bucket < 50 THEN 'control' WHEN bucket < 80 THEN 'diverse'
  WHEN bucket < 100 THEN 'trending_heavy' END AS variant, bucket FROM asg)"""


_VARIANTS_SQL = "vars AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{e}', '{v}', {a}, {b}, {c}, {d})" for e, v, a, b, c, d in VARIANTS) + \
    ") t(experiment, variant, w_content, w_collaborative, w_trending, diversity_ratio))"


def _variants(spark):
    return spark.createDataFrame(VARIANTS, "experiment string, variant string, w_content double, "
                                           "w_collaborative double, w_trending double, diversity_ratio double")


# ---------------------------------------------------------------- feed construction
#: Users with fewer interactions take the preferences' route. The spec says 20, which all users of the tables have.
COLD = 60


def _config(spark, sf):
    """Every user's weights and ratio, by variant."""
    return H.with_config(_assign(spark, sf), _variants(spark))


def _feed_profile(spark, sf):
    routes = H.cold_start(fx.users(spark, sf), fx.interactions(spark, sf), fx.preferences(spark, sf), n=COLD)
    return H.feed_profile(_profile(spark, sf), routes, fx.preferences(spark, sf))


def _collaborative(spark, sf):
    """Stands in for ALS scores, which SQL can't give: the engagement matrix (H1) as user_id, item_id, cf_score."""
    m = I.engagement_matrix(_signals(spark, sf).where(F.col("ts") <= fx.as_of_lit()))
    return m.select("user_id", "item_id", F.col("engagement").alias("cf_score"))


def _feed(spark, sf, k=20):
    cand = _candidates(spark, sf, 7 * 24)
    items = cand.select("article_id", "category_slug", F.round(H.recency_factor(F.col("publish_time"), AS_OF), 12).alias("recency"))
    prof, config = _feed_profile(spark, sf), _config(spark, sf)
    scored = H.feed_scores(fx.users(spark, sf), prof, items, _velocity(spark, sf), _collaborative(spark, sf),
                           list(fx.CATEGORY_SLUGS), k, config)
    return H.diverse_feed(scored, H.engaged_categories(prof), k=k, ratio=0.2, cap=0.5, config=config)


def _feed_sql(k: int) -> str:
    per_cat = int(0.5 * k)
    return f"""
{_ASSIGN}, {_VARIANTS_SQL},
cfg AS (SELECT user_id, w_content, w_collaborative, w_trending, CAST(round(diversity_ratio * 100) AS INT) AS pct
  FROM asg2 JOIN vars USING (experiment, variant)),
route AS (SELECT u.user_id, coalesce(c.n, 0) < {COLD} AS cold FROM users u
  LEFT JOIN (SELECT user_id, count(*) AS n FROM interactions GROUP BY user_id) c USING (user_id)),
fp AS (SELECT prof.* FROM prof JOIN route USING (user_id) WHERE NOT cold
  UNION ALL SELECT user_id, trim(unnest(string_split(preferred_categories, ','))), 1.0 FROM preferences JOIN route USING (user_id) WHERE cold),
cand7 AS (SELECT article_id, category_slug, round(CASE WHEN ra <= 4 THEN 1.2 WHEN ra <= 24 THEN 1.0 ELSE pow(0.5, (ra - 24) / 24.0) END, 12) AS rec
  FROM (SELECT *, (epoch({TS}) - epoch(publish_time)) / 3600.0 AS ra FROM articles
  WHERE publish_time > {TS} - INTERVAL 168 HOUR AND publish_time <= {TS})),
nrm AS (SELECT user_id, sqrt(sum(affinity * affinity)) AS n FROM fp GROUP BY user_id),
cs7 AS (SELECT u.user_id, c.article_id, c.category_slug, c.rec, coalesce(p.affinity / nrm.n, 0.0) AS content_score
  FROM users u JOIN cand7 c ON true LEFT JOIN fp p ON p.user_id = u.user_id AND p.category_slug = c.category_slug
  LEFT JOIN nrm ON nrm.user_id = u.user_id),
cf AS (SELECT user_id, item_id, sum(weight) AS cf_score FROM sig WHERE ts <= {TS} AND item_id IN (SELECT article_id FROM cand7) GROUP BY user_id, item_id),
cfx AS (SELECT *, max(greatest(cf_score, 0.0)) OVER (PARTITION BY user_id) AS cmx FROM cf),
csx AS (SELECT *, max(greatest(content_score, 0.0)) OVER (PARTITION BY user_id) AS mx FROM cs7),
vel AS (SELECT item_id, count(*) / 1440.0 AS velocity FROM interactions WHERE ts > {TS} - INTERVAL 1440 MINUTE AND ts <= {TS} GROUP BY item_id),
sc AS (SELECT csx.user_id, csx.article_id, csx.category_slug, cfg.pct, round((
    w_content * CASE WHEN mx > 0 THEN greatest(content_score, 0.0) / mx ELSE 0.0 END
    + w_collaborative * coalesce(CASE WHEN cmx > 0 THEN greatest(cf_score, 0.0) / cmx ELSE 0.0 END, 0.0)
    + w_trending * coalesce(CASE WHEN (SELECT max(velocity) FROM vel) > 0 THEN v.velocity / (SELECT max(velocity) FROM vel) ELSE 0.0 END, 0.0))
    * rec, 9) AS score
  FROM csx JOIN cfg ON cfg.user_id = csx.user_id LEFT JOIN vel v ON v.item_id = csx.article_id
  LEFT JOIN cfx ON cfx.user_id = csx.user_id AND cfx.item_id = csx.article_id),
eng AS (SELECT DISTINCT user_id, category_slug FROM fp WHERE affinity > 0),
s AS (SELECT sc.*, e.user_id IS NULL AS is_div FROM sc LEFT JOIN eng e ON e.user_id = sc.user_id AND e.category_slug = sc.category_slug),
rc AS (SELECT *, row_number() OVER (PARTITION BY user_id, category_slug ORDER BY score DESC, article_id) AS rc FROM s),
u0 AS (SELECT user_id, article_id, category_slug, score, is_div AS diversity, pct FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, is_div ORDER BY score DESC, article_id) AS r FROM rc WHERE is_div OR rc <= {per_cat})
  WHERE r <= CASE WHEN is_div THEN CAST(round(pct * {k} / 100.0) AS INT) ELSE {k} - CAST(round(pct * {k} / 100.0) AS INT) END),
u1 AS (SELECT *, count(*) OVER (PARTITION BY user_id, category_slug) AS cat_n, count(*) OVER (PARTITION BY user_id) AS tot,
  row_number() OVER (PARTITION BY user_id, category_slug ORDER BY score DESC, article_id) AS cat_rank FROM u0),
big AS (SELECT user_id, category_slug AS bigc, cat_n AS m FROM (SELECT DISTINCT user_id, category_slug, cat_n FROM u1)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cat_n DESC, category_slug) = 1),
kept AS (SELECT u1.*, tot - m = 0 AS cap_relaxed FROM u1 JOIN big USING (user_id)
  WHERE CASE WHEN tot - m = 0 THEN cat_rank <= {per_cat}
             WHEN category_slug = bigc THEN cat_rank <= least(m, floor((tot - m) * 0.5 / 0.5)) ELSE true END),
sl AS (SELECT *, row_number() OVER (PARTITION BY user_id, diversity ORDER BY score DESC, article_id) AS rr FROM kept),
feed AS (SELECT user_id, article_id, category_slug, score, diversity, cap_relaxed,
  row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN diversity THEN (rr * 100 + pct - 1) // pct ELSE rr + (rr - 1) * pct // (100 - pct) END,
    diversity DESC) AS position FROM sl)
"""


@query("h11_diverse_feed", _sql(_feed_sql(20) + "SELECT user_id, article_id, category_slug, round(score, 6) AS score, diversity, cap_relaxed, position FROM feed", "interactions", "users", "preferences"))
def h11_diverse_feed(spark, sf):
    return _feed(spark, sf).withColumn("score", r6("score"))


@query("h12_feed_skew", _sql(_feed_sql(20) + """
SELECT user_id, category_slug, count(*) AS items, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share,
  count(*) / sum(count(*)) OVER (PARTITION BY user_id) > 0.5 AS skewed FROM feed GROUP BY user_id, category_slug
""", "interactions", "users", "preferences"))
def h12_feed_skew(spark, sf):
    return H.feed_skew(_feed(spark, sf)).withColumn("share", r6("share"))


@query("h13_ab_assign", with_views(f"WITH {_ASSIGN}\nSELECT * FROM asg2", "users"))
def h13_ab_assign(spark, sf):
    return _assign(spark, sf)


@query("h14_with_config", with_views(f"""WITH {_ASSIGN}, {_VARIANTS_SQL}
SELECT asg2.experiment, asg2.variant, user_id, bucket, w_content, w_collaborative, w_trending, diversity_ratio
FROM asg2 LEFT JOIN vars USING (experiment, variant)""", "users"))
def h14_with_config(spark, sf):
    return _config(spark, sf)


@query("h15_ab_metrics", with_views(f"""WITH {_ASSIGN},
e AS (SELECT ie.*, a.experiment, a.variant FROM ievents ie JOIN asg2 a USING (user_id)),
b AS (SELECT experiment, variant, count(*) FILTER (WHERE interaction_type = 'read') AS reads,
  count(*) FILTER (WHERE action IN ('like','bookmark','comment','share')) AS engagements,
  avg(CASE WHEN interaction_type = 'read' THEN time_spent_seconds END) AS avg_time_spent FROM e GROUP BY experiment, variant),
c AS (SELECT experiment, variant, category_slug, count(*) AS n FROM e JOIN articles ar ON ar.article_id = e.item_id
  WHERE interaction_type = 'read' GROUP BY experiment, variant, category_slug),
en AS (SELECT experiment, variant, -sum(p * ln(p)) / ln(19) AS diversity FROM (
  SELECT *, n / sum(n) OVER (PARTITION BY experiment, variant) AS p FROM c) GROUP BY experiment, variant)
SELECT b.experiment, b.variant, reads, engagements, round(avg_time_spent, 6) AS avg_time_spent, round(diversity, 6) AS diversity,
  round(CASE WHEN reads > 0 THEN engagements / reads END, 6) AS ctr
FROM b LEFT JOIN en USING (experiment, variant)""", "users", "ievents", "articles"))
def h15_ab_metrics(spark, sf):
    m = H.ab_metrics(_assign(spark, sf), fx.interaction_events(spark, sf), _items(spark, sf))
    return m.select("experiment", "variant", "reads", "engagements", r6("avg_time_spent").alias("avg_time_spent"),
                    r6("diversity").alias("diversity"), r6("ctr").alias("ctr"))


@query("h16_precompute_feeds", _sql(_feed_sql(50) + f"""
SELECT f.user_id, u.language, f.article_id, f.position, round(f.score, 6) AS score FROM feed f
JOIN users u ON u.user_id = f.user_id
WHERE f.user_id IN (SELECT user_id FROM interactions WHERE ts > {TS} - INTERVAL 7 DAY AND ts <= {TS})
""", "interactions", "users", "preferences"))
def h16_precompute_feeds(spark, sf):
    from inkwell.functions.time import in_window
    active = fx.interactions(spark, sf).where(in_window(F.col("ts"), AS_OF, 7 * 86400)).select("user_id").distinct()
    f = _feed(spark, sf, k=50).join(active, "user_id", "left_semi")
    return f.join(fx.users(spark, sf), "user_id").select("user_id", "language", "article_id", "position",
                                                         r6("score").alias("score"))


@query("h17_rank_auc", _sql("""
nrm AS (SELECT user_id, sqrt(sum(affinity * affinity)) AS n FROM prof GROUP BY user_id),
items AS (SELECT DISTINCT item_id FROM ievents),
sc AS (SELECT p.user_id, a.article_id, p.affinity / nrm.n AS score FROM prof p JOIN nrm USING (user_id)
  JOIN articles a ON a.category_slug = p.category_slug JOIN items i ON i.item_id = a.article_id),
likes AS (SELECT user_id, item_id AS article_id FROM (SELECT user_id, item_id, action,
  row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) AS rn FROM ievents WHERE action IN ('like','unlike'))
  WHERE rn = 1 AND action = 'like'),
r AS (SELECT sc.*, l.user_id IS NOT NULL AS pos, rank() OVER (PARTITION BY sc.user_id ORDER BY score)
   + (count(*) OVER (PARTITION BY sc.user_id, score) - 1) / 2.0 AS ar
  FROM sc LEFT JOIN likes l ON l.user_id = sc.user_id AND l.article_id = sc.article_id),
g AS (SELECT user_id, sum(CASE WHEN pos THEN ar END) AS rs, count(*) FILTER (WHERE pos) AS positives,
  count(*) FILTER (WHERE NOT pos) AS negatives FROM r GROUP BY user_id)
SELECT user_id, positives, negatives,
  round(CASE WHEN positives > 0 AND negatives > 0 THEN (rs - positives * (positives + 1) / 2.0) / (positives * negatives) END, 6) AS auc FROM g
"""))
def h17_rank_auc(spark, sf):
    ev = fx.interaction_events(spark, sf)
    items = _items(spark, sf).join(ev.select(F.col("item_id").alias("article_id")).distinct(), "article_id", "left_semi")
    scores = H.content_scores(_profile(spark, sf), items).select("user_id", "article_id",
                                                                 F.col("content_score").alias("score"))
    likes = (I.toggle_state(ev).where((F.col("kind") == "like") & F.col("active"))
             .select("user_id", F.col("item_id").alias("article_id")))
    return H.rank_auc(scores, likes).withColumn("auc", r6("auc"))


@query("h18_stale_feeds", with_views(f"""
WITH ev AS (SELECT DISTINCT user_id, 'interaction' AS reason FROM ievents
  WHERE action IN ('like','share','comment') AND ts > {TS} - INTERVAL 12 HOUR),
na AS (SELECT u.user_id, 'new_articles' AS reason FROM users u JOIN (SELECT language, max(publish_time) AS newest FROM articles GROUP BY language) n
  ON n.language = u.language WHERE n.newest > {TS} - INTERVAL 12 HOUR)
SELECT user_id, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons FROM (SELECT * FROM ev UNION ALL SELECT * FROM na)
GROUP BY user_id
""", "ievents", "users", "articles"))
def h18_stale_feeds(spark, sf):
    users = fx.users(spark, sf)
    feeds = users.select("user_id", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz").alias("built_at"))
    return H.stale_feeds(fx.interaction_events(spark, sf), feeds, fx.articles(spark, sf), users)


@query("h19_list_overlap", _sql(f"""{_CAND},
{_CS},
a AS (SELECT user_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY content_score DESC, article_id) AS r FROM cs) WHERE r <= 10),
v AS (SELECT item_id, count(*) / 1440.0 AS velocity FROM interactions WHERE ts > {TS} - INTERVAL 1440 MINUTE AND ts <= {TS} GROUP BY item_id),
t AS (SELECT ar.language, ar.article_id, row_number() OVER (PARTITION BY ar.language ORDER BY velocity DESC, ar.article_id) AS r
  FROM v JOIN articles ar ON ar.article_id = v.item_id),
b AS (SELECT u.user_id, t.article_id FROM users u JOIN t ON t.language = u.language WHERE t.r <= 10),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.article_id IS NOT NULL AND b.article_id IS NOT NULL AS both_
  FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.article_id = b.article_id)
SELECT user_id, count(*) FILTER (WHERE both_) AS inter, count(*) AS "union", round(count(*) FILTER (WHERE both_) / count(*), 6) AS jaccard
FROM j GROUP BY user_id
""", "interactions", "users"))
def h19_list_overlap(spark, sf):
    from pyspark.sql import Window
    c = H.content_scores(_profile(spark, sf), H.first_of_category(_candidates(spark, sf), 10))
    a = c.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(
        F.col("content_score").desc(), F.col("article_id"))))
    t = G.trending(_velocity(spark, sf), fx.articles(spark, sf), 10)
    b = fx.users(spark, sf).join(t.select("language", "article_id", "rank"), "language").select(
        "user_id", "article_id", "rank")
    return H.list_overlap(a, b, 10).withColumn("jaccard", r6("jaccard"))
