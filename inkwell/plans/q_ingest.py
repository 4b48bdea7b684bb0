"""Registered queries: configuration, feeds and categories on inputs derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions.text import host_of
from inkwell.operators import categories as C
from inkwell.operators import ingest as G
from inkwell.operators import parse as B
from inkwell.operators import registry as A
from inkwell.plans import duck_exprs as D
from inkwell.plans.catalog import query, r6
from inkwell.plans.oracle_views import with_views
from inkwell.sources import fixtures as fx
from inkwell.sources.tables import read_table

_N = "CAST(substring(source_name, 4) AS INT)"


# ---------------------------------------------------------------- A4: JSON side from the log, DB side from documents
@query("a4_merge_sources", with_views(f"""
WITH j AS (SELECT DISTINCT upper(source_name) AS name, source_name AS source_key, status FROM scrape_log WHERE {_N} < 15),
js AS (SELECT source_key, name, 'https://' || source_key || '.test/' || status AS base_url,
  CASE WHEN status = 'error' THEN 'static' ELSE 'rss' END AS scrape_type, 'en' AS language, 'business' AS category_slug,
  CAST(2 AS BIGINT) AS priority, 3.5 AS rate_limit_seconds, true AS is_active,
  row_number() OVER (PARTITION BY source_key ORDER BY status DESC) AS r FROM j),
db AS (SELECT source_name AS source_key, source_name AS name, 'https://db0.test/' || source_name AS base_url, 'rss' AS scrape_type,
  'en' AS language, 'national' AS category_slug, CAST(1 AS BIGINT) AS priority, 2.0 AS rate_limit_seconds, true AS is_active
  FROM sources WHERE {_N} >= 5)
SELECT source_key, name, base_url, scrape_type, language, category_slug, priority, rate_limit_seconds, is_active FROM js WHERE r = 1
UNION ALL SELECT * FROM db WHERE source_key NOT IN (SELECT source_key FROM js)
""", "scrape_log", "sources"))
def a4_merge_sources(spark, sf):
    """Each source of the log has a config file for each result seen; two database rows stand for each source of documents."""
    seen = fx.scrape_log(spark, sf).where(f"{_N} < 15").select("source_name", "status").distinct()
    config = seen.select(
        F.upper("source_name").alias("name"), F.concat(F.lit("https://"), "source_name", F.lit(".test/"), "status").alias("base_url"),
        F.when(F.col("status") == "error", "static").otherwise("rss").alias("scrape_type"), F.lit("en").alias("language"),
        F.lit("business").alias("category_slug"), F.lit(2).alias("priority"), F.lit(3.5).alias("rate_limit_seconds"),
        F.lit(True).alias("is_active"), F.lit(None).cast("string").alias("feed_url"),
        *(F.lit(None).cast("string").alias(c) for c in A.SELECTOR_FIELDS),
        *(F.lit(None).cast("map<string,string>").alias(c) for c in ("category_mapping", "custom_headers")),
        F.concat("status", F.lit(".json")).alias("file_name"))
    rows = fx.sources(spark, sf).where(f"{_N} >= 5").select("source_name", F.explode(F.array(F.lit(0), F.lit(1))).alias("db_seq"))
    stored = rows.select(
        F.col("source_name").alias("name"), F.concat(F.lit("https://db"), F.col("db_seq").cast("string"), F.lit(".test/"), "source_name").alias("url"),
        F.lit("rss").alias("scrape_type"), *(F.lit(None).cast(t).alias(c) for c, t in (
            ("language", "string"), ("category_slug", "string"), ("is_active", "boolean"), ("feed_url", "string"))), "db_seq")
    return A.merge_sources(config, stored).select("source_key", "name", "base_url", "scrape_type", "language", "category_slug",
                                                  "priority", "rate_limit_seconds", "is_active")


# ---------------------------------------------------------------- A11: documents as feeds, parsed back
def _escaped(c):
    out = F.col(c)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def _tag(name, value, attributes=""):
    return F.concat(F.lit(f"<{name}{attributes}>"), value, F.lit(f"</{name}>"))


@query("a11_parse_feeds", r"""
SELECT source AS source_name, CASE WHEN doc_id % 2 = 0 THEN 'rss' ELSE 'atom' END AS feed_format, 'Document ' || doc_id AS title,
  'https://feeds.test/' || doc_id || '?a=1&b=2' AS url, 'id-' || doc_id AS guid, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content
FROM documents
""")
def a11_parse_feeds(spark, sf):
    """Every document as a feed of one entry, RSS for even ids and Atom for odd ones, with its whole text as content."""
    number = F.col("doc_id").cast("string")
    docs = read_table(spark, sf, "documents").withColumns({
        "title": F.concat(F.lit("Document "), number), "url": F.concat(F.lit("https://feeds.test/"), number, F.lit("?a=1&b=2")),
        "guid": F.concat(F.lit("id-"), number)})
    url = _escaped("url")
    rss = _tag("rss", _tag("channel", _tag("item", F.concat(
        _tag("title", _escaped("title")), _tag("link", url), _tag("guid", "guid"), _tag("content:encoded", _escaped("text"))))),
        ' xmlns:content="http://purl.org/rss/1.0/modules/content/"')
    atom = _tag("feed", _tag("entry", F.concat(
        _tag("title", _escaped("title")), _tag("id", "guid"), F.lit('<link rel="alternate" href="'), url, F.lit('"/>'),
        _tag("content", _escaped("text")))), ' xmlns="http://www.w3.org/2005/Atom"')
    feeds = docs.select(F.col("source").alias("source_name"), F.when(F.col("doc_id") % 2 == 0, rss).otherwise(atom).alias("xml"))
    return G.parse_feeds(feeds).select("source_name", "feed_format", "title", "url", "guid", "content")


# ---------------------------------------------------------------- A15: changes from the log
@query("a15_update_sources", with_views("""
WITH ch AS (SELECT 'src' || (seq % 25) AS source_name, ts, seq, CASE WHEN status = 'error' THEN 3 END AS priority,
  CASE WHEN seq % 3 = 0 THEN (seq % 10) / 10.0 END AS reliability_score FROM scrape_log),
l AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY ts DESC, seq DESC) = 1)
SELECT coalesce(s.source_name, l.source_name) AS source_name, coalesce(l.priority, s.priority) AS priority,
  round(coalesce(l.reliability_score, s.reliability_score), 6) AS reliability_score
FROM sources s FULL OUTER JOIN l ON l.source_name = s.source_name
""", "scrape_log", "sources"))
def a15_update_sources(spark, sf):
    log = fx.scrape_log(spark, sf)
    changes = log.select(
        F.concat(F.lit("src"), (F.col("seq") % 25).cast("string")).alias("source_name"), F.struct("ts", "seq").alias("changed_at"),
        F.when(F.col("status") == "error", 3).alias("priority"),
        F.when(F.col("seq") % 3 == 0, (F.col("seq") % 10) / F.lit(10.0)).alias("reliability_score"))
    out = A.update_sources(fx.sources(spark, sf), changes)
    return out.withColumn("reliability_score", r6("reliability_score"))


# ---------------------------------------------------------------- B4: categories of pages
#: Prefix maps that overlap, per site; org has none. Fixed values for the check.
RULES = [("example.com", "/en/", "national"), ("example.com", "/en/8", "business"), ("example.com", "/en/82", "finance"),
         ("example.com", "/fr/", "international"), ("example.net", "/es/5", "sports"), ("example.net", "/en/9", "science"),
         ("example.net", "/en", "technology")]
DEFAULTS = [("example.com", "politics"), ("example.net", "opinion")]
#: The fixed keywords, and words of the tables' invented prose.
WORDS = C.KEYWORDS | {"politics": (*C.KEYWORDS["politics"], "the of"), "health": (*C.KEYWORDS["health"], "der", "and the"),
                      "lifestyle": (*C.KEYWORDS["lifestyle"], "la", "le la"), "crime": (*C.KEYWORDS["crime"], "el", "los que")}


def _values(rows):
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


@query("b4_assign_category", f"""
WITH rules(source_key, prefix, slug) AS (VALUES {_values(RULES)}), defaults(source_key, slug) AS (VALUES {_values(DEFAULTS)}),
kw(place, slug, word) AS (VALUES {_values([(i, s, w) for i, (s, ws) in enumerate(WORDS.items()) for w in ws])}),
p AS (SELECT page_id, regexp_extract({D.host('url')}, '([^.]+[.][^.]+)$', 1) AS source_key,
  CASE WHEN regexp_extract(url, '{D.SCHEME}[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '{D.SCHEME}[^/?#]*([^?#]*)', 1) END AS path,
  ' ' || array_to_string({D.tokens(D.html_to_text('html'))}, ' ') || ' ' AS words FROM pages),
pre AS (SELECT page_id, slug FROM p JOIN rules ON rules.source_key = p.source_key AND starts_with(path, prefix)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC, slug) = 1),
hits AS (SELECT page_id, place, kw.slug, count(*) AS n FROM p JOIN kw ON contains(words, ' ' || word || ' ') GROUP BY ALL),
key AS (SELECT page_id, slug FROM hits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, place) = 1)
SELECT p.page_id, coalesce(pre.slug, key.slug, defaults.slug, 'national') AS category_slug,
  CASE WHEN pre.slug IS NOT NULL THEN 'prefix' WHEN key.slug IS NOT NULL THEN 'keyword' ELSE 'default' END AS category_by
FROM p LEFT JOIN pre USING (page_id) LEFT JOIN key USING (page_id) LEFT JOIN defaults ON defaults.source_key = p.source_key
""")
def b4_assign_category(spark, sf):
    pages = B.extract_text(read_table(spark, sf, "pages"), "html")
    articles = pages.select("page_id", "url", F.regexp_extract(host_of("url"), "([^.]+[.][^.]+)$", 1).alias("source_key"),
                            F.col("text").alias("content"))
    rules = spark.createDataFrame(RULES, "source_key string, prefix string, category_slug string")
    defaults = spark.createDataFrame(DEFAULTS, "source_key string, category_slug string")
    return C.assign_category(articles, rules, defaults, WORDS).select("page_id", "category_slug", "category_by")


# ---------------------------------------------------------------- B12: feed entries that point at pages
@query("b12_feed_body", f"""
WITH t AS (SELECT page_id, url, {D.canonical_url('url')} AS k, {D.html_to_text('html')} AS text FROM pages),
e AS (SELECT page_id AS entry_id, k, CASE WHEN page_id % 2 = 0 THEN text ELSE left(text, 60) END AS content,
  left(text, 20) AS summary FROM t),
pg AS (SELECT k, text FROM t WHERE page_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id DESC) = 1)
SELECT entry_id, CASE WHEN {D.word_count('content')} >= 100 THEN 'feed' WHEN pg.text IS NOT NULL THEN 'page' ELSE 'feed_partial' END AS body_origin,
  CASE WHEN {D.word_count('content')} >= 100 THEN content ELSE coalesce(pg.text, content, summary) END AS body
FROM e LEFT JOIN pg USING (k)
""")
def b12_feed_body(spark, sf):
    """An entry for every page, half of them cut short; four in five pages are there to fill those."""
    pages = B.extract_text(read_table(spark, sf, "pages"), "html").select("page_id", "url", "text")
    short = F.when(F.col("page_id") % 2 == 0, F.col("text")).otherwise(F.left("text", F.lit(60)))
    entries = pages.select(F.col("page_id").alias("entry_id"), "url", short.alias("content"), F.left("text", F.lit(20)).alias("summary"))
    return G.feed_body(entries, pages.where("page_id % 5 <> 0")).select("entry_id", "body_origin", "body")

