"""Registered queries: feed paging/filters (I1-I4) and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions.text import tokens
from inkwell.functions.time import in_window
from inkwell.operators import interactions as I
from inkwell.operators import search as S
from inkwell.operators import trending as G
from inkwell.operators.users import explode_prefs
from inkwell.plans import duck_exprs as D
from inkwell.plans.catalog import query, r6
from inkwell.plans.oracle_views import with_views
from inkwell.sources import fixtures as fx
from inkwell.sources.tables import read_table

AS_OF = fx.AS_OF
TS = "TIMESTAMP '2024-01-31 00:00:00'"
CURSOR = ("2024-01-30 12:00:00", 0)


@query("i1_page", with_views("""
SELECT article_id, publish_time, language, position,
  CASE WHEN position = 20 AND cnt > 20 THEN publish_time END AS next_cursor_publish_time,
  CASE WHEN position = 20 AND cnt > 20 THEN article_id END AS next_cursor_article_id
FROM (SELECT *, row_number() OVER (ORDER BY publish_time DESC, article_id DESC) AS position, count(*) OVER () AS cnt FROM (
  SELECT article_id, publish_time, language FROM articles
  WHERE publish_time < TIMESTAMP '2024-01-30 12:00:00' OR (publish_time = TIMESTAMP '2024-01-30 12:00:00' AND article_id < 0)
  ORDER BY publish_time DESC, article_id DESC LIMIT 21)) WHERE position <= 20
""", "articles"))
def i1_page(spark, sf):
    a = fx.articles(spark, sf).select("article_id", "publish_time", "language")
    return S.page(a, ["publish_time", "article_id"], CURSOR, 20)


@query("i2_feed_filter", with_views(f"""
SELECT article_id, category_slug, publish_time FROM articles WHERE language = 'en' AND category_slug IN ('sports', 'politics')
  AND publish_time >= {TS} - INTERVAL 7 DAY AND publish_time <= {TS}
""", "articles"))
def i2_feed_filter(spark, sf):
    f = S.feed_filter(fx.articles(spark, sf), "en", ["sports", "politics"], since="2024-01-24 00:00:00", until=AS_OF)
    return f.select("article_id", "category_slug", "publish_time")


def _trending(spark, sf, k=10):
    v = G.velocity(fx.interactions(spark, sf), AS_OF, minutes=24 * 60)
    return G.trending(v, fx.articles(spark, sf), k)


def _default_feed(spark, sf, k=20):
    arts = fx.articles(spark, sf).where(in_window(F.col("publish_time"), AS_OF, 7 * 86400))
    # Top-k recent articles per (language, category) first, then per user.
    cat_top = G.top_k(arts.select("article_id", "language", "category_slug", "publish_time"),
                      ["language", "category_slug"], [F.col("publish_time").desc(), F.col("article_id")], k)
    users = fx.users(spark, sf)
    prefs = explode_prefs(fx.preferences(spark, sf)).where(F.col("kind") == "category") \
        .select("user_id", F.col("value").alias("category_slug"))
    up = prefs.join(users, "user_id").join(cat_top.drop("rank"), ["language", "category_slug"])
    w = Window.partitionBy("user_id").orderBy(F.col("publish_time").desc(), F.col("article_id"))
    pref_top = up.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return S.default_feed(users, _trending(spark, sf), pref_top, k)


_DEFAULT_FEED = f"""
tr AS (SELECT * FROM (SELECT a.article_id, a.language, row_number() OVER (PARTITION BY a.language ORDER BY v.n DESC, a.article_id) AS rank
  FROM (SELECT item_id, count(*) AS n FROM interactions WHERE ts > {TS} - INTERVAL 1440 MINUTE AND ts <= {TS} GROUP BY item_id) v
  JOIN articles a ON a.article_id = v.item_id) WHERE rank <= 10),
arts AS (SELECT * FROM articles WHERE publish_time > {TS} - INTERVAL 7 DAY AND publish_time <= {TS}),
ct AS (SELECT * FROM (SELECT article_id, language, category_slug, publish_time,
  row_number() OVER (PARTITION BY language, category_slug ORDER BY publish_time DESC, article_id) AS r FROM arts) WHERE r <= 20),
pc AS (SELECT DISTINCT user_id, trim(unnest(string_split(preferred_categories, ','))) AS category_slug FROM preferences),
up AS (SELECT * FROM (SELECT pc.user_id, ct.article_id, row_number() OVER (PARTITION BY pc.user_id ORDER BY ct.publish_time DESC, ct.article_id) AS rank
  FROM pc JOIN users u ON u.user_id = pc.user_id JOIN ct ON ct.language = u.language AND ct.category_slug = pc.category_slug) WHERE rank <= 20),
sl AS (SELECT user_id, article_id, min(slot) AS slot FROM (
  SELECT u.user_id, tr.article_id, tr.rank * 2 - 1 AS slot FROM users u JOIN tr ON tr.language = u.language
  UNION ALL SELECT user_id, article_id, rank * 2 FROM up) GROUP BY user_id, article_id),
df AS (SELECT * FROM (SELECT user_id, article_id, row_number() OVER (PARTITION BY user_id ORDER BY slot, article_id) AS position FROM sl) WHERE position <= 20)
"""


@query("i3_default_feed", with_views("WITH " + _DEFAULT_FEED.strip() + "\nSELECT user_id, article_id, position FROM df",
                                     "articles", "interactions", "users", "preferences"))
def i3_default_feed(spark, sf):
    return _default_feed(spark, sf)


@query("i4_feed_items", with_views("WITH " + _DEFAULT_FEED.strip() + f""",
cnt AS (SELECT item_id, count(*) FILTER (WHERE interaction_type = 'read') AS reads,
  count(*) FILTER (WHERE interaction_type = 'comment') AS comments, count(*) FILTER (WHERE interaction_type = 'share') AS shares
  FROM ievents GROUP BY item_id),
st AS (SELECT user_id, item_id, kind, action FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, kind ORDER BY ts DESC, event_id DESC) AS rn
  FROM (SELECT *, CASE WHEN action IN ('like','unlike') THEN 'like' WHEN action IN ('bookmark','unbookmark') THEN 'bookmark' END AS kind FROM ievents)
  WHERE kind IS NOT NULL) WHERE rn = 1),
tg AS (SELECT item_id, count(*) FILTER (WHERE kind = 'like') AS likes, count(*) FILTER (WHERE kind = 'bookmark') AS bookmarks
  FROM st WHERE action IN ('like', 'bookmark') GROUP BY item_id),
c AS (SELECT coalesce(cnt.item_id, tg.item_id) AS item_id, reads, likes, comments, shares, bookmarks FROM cnt FULL OUTER JOIN tg ON cnt.item_id = tg.item_id)
SELECT df.user_id, df.position, df.article_id, a.title, a.category_slug, a.publish_time,
  CAST(coalesce(reads, 0) AS BIGINT) AS reads, CAST(coalesce(likes, 0) AS BIGINT) AS likes, CAST(coalesce(comments, 0) AS BIGINT) AS comments,
  CAST(coalesce(shares, 0) AS BIGINT) AS shares, CAST(coalesce(bookmarks, 0) AS BIGINT) AS bookmarks,
  CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(s // 60 AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(s // 3600 AS BIGINT) || 'h ago'
    WHEN s < 604800 THEN CAST(s // 86400 AS BIGINT) || 'd ago' ELSE CAST(s // 604800 AS BIGINT) || 'w ago' END AS time_ago
FROM df JOIN (SELECT *, date_diff('second', publish_time, {TS}) AS s FROM articles) a ON a.article_id = df.article_id
LEFT JOIN c ON c.item_id = df.article_id
""", "articles", "interactions", "ievents", "users", "preferences"))
def i4_feed_items(spark, sf):
    counts = I.interaction_counts(fx.interaction_events(spark, sf))
    return S.feed_items(_default_feed(spark, sf), fx.articles(spark, sf), counts, AS_OF)


def _index(spark, sf):
    return S.build_index(read_table(spark, sf, "documents"))


_TOK_DOCS = f"dt AS (SELECT doc_id, lang AS language, {D.tokens('text')} AS t FROM documents)"
_POST = "post AS (SELECT term, doc_id, language, count(*) AS tf FROM (SELECT doc_id, language, unnest(t) AS term FROM dt) GROUP BY term, doc_id, language)"


@query("i5_build_index", f"""WITH {_TOK_DOCS}, {_POST}
SELECT language, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY language, term""")
def i5_build_index(spark, sf):
    post, _ = _index(spark, sf)
    return S.term_stats(post)


def _queries(spark, sf):
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_SEARCH = f"""{_TOK_DOCS}, {_POST},
stats AS (SELECT doc_id, len(t) AS doc_len FROM dt),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({D.tokens('text')}) AS term FROM benchmark)),
sc AS (SELECT qt.query_id, post.doc_id, sum(ln(1.0 + ((SELECT count(*) FROM stats) - dfs.df + 0.5) / (dfs.df + 0.5))
  * post.tf * 2.2 / (post.tf + 1.2 * (0.25 + 0.75 * stats.doc_len / (SELECT avg(doc_len) FROM stats)))) AS score0
  FROM qt JOIN dfs ON dfs.term = qt.term JOIN post ON post.term = qt.term JOIN stats ON stats.doc_id = post.doc_id
  GROUP BY qt.query_id, post.doc_id),
sc2 AS (SELECT query_id, doc_id, round(score0, 9) AS score FROM sc),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc2) WHERE rank <= 10)"""


@query("i6_search", f"WITH {_SEARCH}\nSELECT query_id, doc_id, round(score, 6) AS score, rank FROM hits")
def i6_search(spark, sf):
    post, stats = _index(spark, sf)
    return S.search(post, stats, _queries(spark, sf), k=10).withColumn("score", r6("score"))


@query("i7_expand_terms")
def i7_expand_terms(spark, sf):
    """Rows-only here: DuckDB's levenshtein counts bytes, not characters, on
    accented text; tests/test_search.py checks this query against a brute-force
    character-level edit distance instead."""
    q = read_table(spark, sf, "benchmark").select(F.explode(tokens("text")).alias("term"))
    v = read_table(spark, sf, "documents").select(F.explode(tokens("text")).alias("term"))
    return S.expand_terms(q, v)


@query("i8_facets", with_views(f"""WITH {_SEARCH}
SELECT a.category_slug, a.source_name, CAST(a.publish_time AS DATE) AS publish_date, count(*) AS hits,
  GROUPING(a.category_slug, a.source_name, CAST(a.publish_time AS DATE)) AS facet_id
FROM hits h JOIN articles a ON a.article_id = h.doc_id
GROUP BY GROUPING SETS ((a.category_slug), (a.source_name), (CAST(a.publish_time AS DATE)))
""", "articles"))
def i8_facets(spark, sf):
    post, stats = _index(spark, sf)
    hits = S.search(post, stats, _queries(spark, sf), k=10)
    a = fx.articles(spark, sf).select(F.col("article_id").alias("doc_id"), "category_slug", "source_name", "publish_time")
    return S.facets(hits.join(a, "doc_id"))


@query("i9_search_or_trending", with_views(f"""WITH {_SEARCH},
v AS (SELECT item_id, count(*) / 1440.0 AS velocity FROM interactions WHERE ts > {TS} - INTERVAL 1440 MINUTE AND ts <= {TS} GROUP BY item_id),
tr AS (SELECT * FROM (SELECT a.article_id AS doc_id, row_number() OVER (ORDER BY velocity DESC, a.article_id) AS rank
  FROM v JOIN articles a ON a.article_id = v.item_id WHERE a.language = 'en') WHERE rank <= 10)
SELECT query_id, doc_id, rank, 'search' AS source FROM hits
UNION ALL SELECT -1 AS query_id, doc_id, rank, 'trending' FROM tr
""", "articles", "interactions"))
def i9_search_or_trending(spark, sf):
    post, stats = _index(spark, sf)
    empty = spark.createDataFrame([(-1, "")], "query_id bigint, query string")
    q = _queries(spark, sf).unionByName(empty)
    t = _trending(spark, sf).where(F.col("language") == "en").select(F.col("article_id").alias("doc_id"), "rank")
    return S.search_or_trending(post, stats, q, t, k=10)


@query("i10_sync_index", f"""WITH {_TOK_DOCS}, {_POST}
SELECT language, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY language, term""")
def i10_sync_index(spark, sf):
    docs = read_table(spark, sf, "documents")
    labels = read_table(spark, sf, "labels")
    base = docs.join(labels, "doc_id", "left_anti")
    added = docs.join(labels, "doc_id", "left_semi")
    deleted = labels.where(F.col("toxic") == 1).select("doc_id")
    post, stats = S.build_index(base)
    post2, _ = S.sync_index(post, stats, added, deleted)
    return S.term_stats(post2)
