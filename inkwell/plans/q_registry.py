"""Registered queries: source registry family (A*) over the scrape log, the
source dimension and the raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions.text import canonical_url, host_of
from inkwell.operators import registry as A
from inkwell.operators.ingest import upsert_articles
from inkwell.plans import duck_exprs as D
from inkwell.plans.catalog import query, r6
from inkwell.plans.oracle_views import with_views
from inkwell.sources import fixtures as fx
from inkwell.sources import sinks
from inkwell.sources.tables import read_table
from inkwell.streaming.jobs import work_dir

AS_OF = fx.AS_OF
TS = "TIMESTAMP '2024-01-31 00:00:00'"


@query("a3_source_key", with_views(f"""
SELECT source_name, {D.source_key('source_name')} AS source_key FROM sources
""", "sources"))
def a3_source_key(spark, sf):
    s = fx.sources(spark, sf)
    return s.select("source_name", A.source_key("source_name").alias("source_key"))


def _health(spark, sf):
    return A.source_health(fx.scrape_log(spark, sf), fx.sources(spark, sf))


_HEALTH_SQL = f"""
WITH log AS (SELECT *, {D.source_key('source_name')} AS source_key FROM scrape_log
  WHERE {D.source_key('source_name')} IN (SELECT {D.source_key('source_name')} FROM sources)),
last AS (SELECT source_key, status AS last_status FROM (
  SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY ts DESC, seq DESC) AS rn FROM log) WHERE rn = 1),
agg AS (SELECT source_key, count(*) FILTER (WHERE status = 'success') AS success_count,
  count(*) FILTER (WHERE status = 'error') AS error_count, max(ts) AS last_scrape_time,
  max(CASE WHEN status = 'error' THEN ts END) AS last_error_time FROM log GROUP BY source_key),
h AS (SELECT agg.*, CAST(NULL AS VARCHAR) AS last_error,
  CASE WHEN success_count + error_count = 0 THEN 1.0 ELSE success_count / (success_count + error_count) END AS success_rate,
  last_status FROM agg JOIN last USING (source_key))
"""


@query("a6_source_health", with_views(_HEALTH_SQL + """
SELECT source_key, success_count, error_count, last_scrape_time, last_error_time, last_error,
  round(success_rate, 6) AS success_rate,
  (last_status = 'success' OR success_rate >= 0.5 OR success_count + error_count = 0) AS is_healthy FROM h
""", "scrape_log", "sources"))
def a6_source_health(spark, sf):
    return _health(spark, sf).withColumn("success_rate", r6("success_rate"))


@query("a7_sources_with_health", with_views(_HEALTH_SQL + f"""
SELECT s.source_name, s.priority, s.reliability_score, {D.source_key('s.source_name')} AS source_key,
  CAST(coalesce(h.success_count, 0) AS BIGINT) AS success_count, CAST(coalesce(h.error_count, 0) AS BIGINT) AS error_count,
  h.last_scrape_time, h.last_error, round(coalesce(h.success_rate, 1.0), 6) AS success_rate,
  coalesce(h.last_status = 'success' OR h.success_rate >= 0.5 OR h.success_count + h.error_count = 0, true) AS is_healthy
FROM sources s LEFT JOIN h ON {D.source_key('s.source_name')} = h.source_key
""", "scrape_log", "sources"))
def a7_sources_with_health(spark, sf):
    j = A.sources_with_health(fx.sources(spark, sf), _health(spark, sf))
    return j.select("source_name", "priority", "reliability_score", "source_key",
                    "health.success_count", "health.error_count", "health.last_scrape_time",
                    "health.last_error", r6("health.success_rate").alias("success_rate"), "health.is_healthy")


def _registry(spark, sf):
    """Source dimension with is_active taken from health (unhealthy → inactive)."""
    j = A.sources_with_health(fx.sources(spark, sf), _health(spark, sf))
    return j.select(F.col("source_name").alias("name"), "priority", "reliability_score",
                    F.col("health.is_healthy").alias("is_active"))


@query("a5_filter_sources", with_views(_HEALTH_SQL + """
SELECT s.source_name AS name, s.priority, s.reliability_score, true AS is_active
FROM sources s LEFT JOIN h ON replace(regexp_replace(lower(s.source_name), '^\\s+|\\s+$', '', 'g'), ' ', '_') = h.source_key
WHERE coalesce(h.last_status = 'success' OR h.success_rate >= 0.5 OR h.success_count + h.error_count = 0, true)
""", "scrape_log", "sources"))
def a5_filter_sources(spark, sf):
    return A.filter_sources(_registry(spark, sf), active_only=True)


@query("a8_failure_runs", with_views(f"""
WITH lg AS (SELECT source_name, ts, seq, status FROM scrape_log WHERE ts <= {TS}),
ok AS (SELECT source_name, ts AS ok_ts, seq AS ok_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY ts DESC, seq DESC) AS rn FROM lg WHERE status = 'success')
  WHERE rn = 1),
agg AS (SELECT lg.source_name,
  count(*) FILTER (WHERE status = 'error' AND (ok_ts IS NULL OR ts > ok_ts OR (ts = ok_ts AND seq > ok_seq))) AS consecutive_failures,
  max(CASE WHEN status = 'error' THEN ts END) AS last_failure
  FROM lg LEFT JOIN ok ON lg.source_name = ok.source_name GROUP BY lg.source_name)
SELECT source_name, CAST(consecutive_failures AS BIGINT) AS consecutive_failures, last_failure,
  consecutive_failures >= 5 AS unhealthy,
  CASE WHEN consecutive_failures >= 5 THEN last_failure + INTERVAL 1800 SECOND END AS retry_at,
  (consecutive_failures >= 5 AND last_failure + INTERVAL 1800 SECOND <= {TS}) AS retry_eligible
FROM agg
""", "scrape_log"))
def a8_failure_runs(spark, sf):
    return A.failure_runs(fx.scrape_log(spark, sf), AS_OF, n=5, cooldown_minutes=30)


@query("a9_seed_dim", with_views("""
SELECT category_slug, display_order FROM (SELECT DISTINCT category_slug, CAST(NULL AS INTEGER) AS display_order FROM articles)
UNION ALL
SELECT category_slug, display_order FROM categories
WHERE category_slug NOT IN (SELECT category_slug FROM articles)
""", "articles", "categories"))
def a9_seed_dim(spark, sf):
    # Existing dimension: the categories already present in the article table.
    existing = fx.articles(spark, sf).select("category_slug").distinct().withColumn(
        "display_order", F.lit(None).cast("int"))
    return A.seed_dim(existing, fx.categories(spark), "category_slug")


@query("a10_read_pages", """
SELECT page_id, url, html, CAST(NULL AS TIMESTAMP) AS fetched_at FROM pages
""")
def a10_read_pages(spark, sf):
    from inkwell.sources.tables import table_path
    return A.read_pages(spark, table_path(sf, "pages"), "parquet")


@query("a12_upsert_articles", f"""
WITH p AS (SELECT page_id, url, {D.canonical_url('url')} AS canonical_url, length(html) AS html_chars FROM pages),
u AS (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY batch DESC, page_id DESC) AS rn FROM (
  SELECT *, 0 AS batch FROM p UNION ALL SELECT *, 1 AS batch FROM p))
SELECT canonical_url, page_id, url, html_chars, batch FROM u WHERE rn = 1
""")
def a12_upsert_articles(spark, sf):
    pages = read_table(spark, sf, "pages").select(
        "page_id", "url", canonical_url("url").alias("canonical_url"), F.length("html").alias("html_chars"))
    # The stored table and the new batch are both the whole page set; the new
    # batch wins per canonical URL and the latest page id wins within a batch.
    existing = pages.withColumn("batch", F.lit(0))
    new = pages.withColumn("batch", F.lit(1))
    return upsert_articles(new, existing, key="canonical_url", order_cols=["batch", "page_id"]).select(
        "canonical_url", "page_id", "url", "html_chars", "batch")


@query("a12_article_sink", f"""
WITH p AS (SELECT page_id, {D.canonical_url('url')} AS canonical_url, length(html) AS html_chars,
  TIMESTAMP '{fx.AS_OF}' - to_minutes(CAST((page_id * 7919) % 43200 AS INT)) AS publish_time FROM pages),
u AS (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY page_id DESC) AS rn FROM p WHERE canonical_url IS NOT NULL)
SELECT canonical_url, page_id, html_chars, CAST(publish_time AS DATE) AS publish_date,
  publish_time <= TIMESTAMP '{fx.AS_OF}' - INTERVAL 14 DAY AS archived FROM u WHERE rn = 1
""")
def a12_article_sink(spark, sf):
    """Three batches upserted into a table partitioned by date, the newest pages not in the last one; then K1 on it."""
    when = F.expr(f"timestampadd(MINUTE, CAST(-((page_id * 7919) % 43200) AS INT), TIMESTAMP_NTZ'{fx.AS_OF}')")
    pages = read_table(spark, sf, "pages").select(
        canonical_url("url").alias("canonical_url"), "page_id", F.length("html").alias("html_chars"),
        when.alias("publish_time"), when.cast("date").alias("publish_date"), F.lit(False).alias("archived"))
    path = work_dir(spark, "articles")
    for batch in (1, 2, 0):
        sinks.upsert(pages.where(F.col("page_id") % 3 == batch), path, "canonical_url", ["page_id"], "publish_date")
    sinks.archive_partitions(spark, path, pages.schema, fx.AS_OF, 14)
    return sinks.read_keyed(spark, path, pages.schema, "canonical_url").drop("publish_time")


@query("a13_crawl_plan", f"""
WITH u AS (SELECT DISTINCT {D.host('url')} AS source_name, url, {D.host('url')} AS host FROM pages),
s AS (SELECT DISTINCT source_name, 2.0 AS rate_limit_seconds,
  {D.md5_bucket('source_name', 600000)} / 1000.0 AS source_offset_s FROM u),
j AS (SELECT u.*, s.rate_limit_seconds, s.source_offset_s,
  row_number() OVER (PARTITION BY host ORDER BY url) AS position FROM u JOIN s USING (source_name))
SELECT source_name, host, url, position, round(source_offset_s, 6) AS source_offset_s,
  round(rate_limit_seconds * (position - 1), 6) AS delay_s,
  round(source_offset_s + rate_limit_seconds * (position - 1), 6) AS scheduled_offset_s FROM j
""")
def a13_crawl_plan(spark, sf):
    pages = read_table(spark, sf, "pages")
    urls = pages.select(host_of("url").alias("source_name"), "url")
    # One source per host, default rate limit, all active.
    sources = urls.select("source_name").distinct().select(
        "source_name", F.lit(2.0).alias("rate_limit_seconds"), F.lit(True).alias("is_active"))
    p = A.crawl_plan(sources, urls, window_s=600)
    return p.select("source_name", "host", "url", "position", r6("source_offset_s").alias("source_offset_s"),
                    r6("delay_s").alias("delay_s"), r6("scheduled_offset_s").alias("scheduled_offset_s"))


# Fixed robots rules for the check: every host disallows these path prefixes.
ROBOTS_RULES = [("*", "/de/"), ("*", "/en/1")]


@query("a14_robots_filter", f"""
WITH p AS (SELECT page_id, url, CASE WHEN {D.url_rest('url')} = '' THEN '/' ELSE {D.url_rest('url')} END AS path FROM pages)
SELECT page_id, url FROM p WHERE NOT (starts_with(path, '/de/') OR starts_with(path, '/en/1'))
""")
def a14_robots_filter(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    rules = spark.createDataFrame(ROBOTS_RULES, "host string, prefix string")
    return A.robots_filter(pages, rules).select("page_id", "url")
