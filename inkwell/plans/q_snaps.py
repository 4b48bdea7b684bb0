"""Registered queries: summaries, translation checks and snaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import content as E
from inkwell.operators import quality as C
from inkwell.operators.langs import SCRIPT_RANGES
from inkwell.plans import duck_exprs as D
from inkwell.plans.catalog import query, r6
from inkwell.plans.oracle_views import with_views
from inkwell.sources import fixtures as fx
from inkwell.sources.tables import read_table


def _bodies(spark, sf):
    return fx.articles(spark, sf).withColumn("body", C.body_of("content"))


def _summaries(spark, sf):
    return E.extractive_summary(_bodies(spark, sf), "article_id", "body", 60, 80)


@query("e1_extractive_summary")
def e1_extractive_summary(spark, sf):
    """Rows-only: per-article extractive summary within 80 words."""
    return _summaries(spark, sf)


@query("e2_validate_summaries")
def e2_validate_summaries(spark, sf):
    """Rows-only: summaries of E1 validated against their titles."""
    s = _summaries(spark, sf).join(fx.articles(spark, sf).select("article_id", "title"), "article_id")
    return E.validate_summaries(s).select("article_id", "summary_words", r6("entity_coverage").alias("entity_coverage"),
                                          "valid")


@query("e3_retry_queue", with_views("""
SELECT source_name, hour, attempts, last_status, CASE WHEN last_status = 'success' THEN 'done'
  WHEN attempts < 2 THEN 'retry' ELSE 'dead_letter' END AS queue FROM (
  SELECT source_name, date_trunc('hour', ts) AS hour, count(*) AS attempts, arg_max(status, seq) AS last_status
  FROM scrape_log GROUP BY source_name, date_trunc('hour', ts))
""", "scrape_log"))
def e3_retry_queue(spark, sf):
    # One work item per (source, hour) of the scrape log; each log row is an attempt.
    r = fx.scrape_log(spark, sf).select("source_name", F.date_trunc("hour", "ts").alias("hour"),
                                        F.col("ts").alias("attempt_ts"), F.col("seq").alias("attempt"), "status")
    q = E.retry_queue(r.withColumn("item_id", F.struct("source_name", "hour")), key="item_id")
    return q.select("item_id.source_name", "item_id.hour", "attempts", "last_status", "queue")


@query("e4_missing_translations", with_views("""
SELECT article_id AS story_id, l.language FROM articles CROSS JOIN (SELECT unnest(['en','hi','ta','te','kn']) AS language) l
WHERE l.language <> articles.language
""", "articles"))
def e4_missing_translations(spark, sf):
    a = fx.articles(spark, sf)
    stories = a.select(F.col("article_id").alias("story_id"))
    snaps = a.select(F.col("article_id").alias("story_id"), "language")  # the original-language snap exists
    return E.missing_translations(stories, snaps)


def _duck_script(x, lang):
    letters = f"len(regexp_extract_all(coalesce({x}, ''), '\\p{{L}}', 0))"
    parts = " ".join(f"WHEN {lang} = '{lg}' THEN len(regexp_extract_all(coalesce({x}, ''), '{rng}', 0))"
                     for lg, rng in SCRIPT_RANGES.items())
    ins = f"CASE {parts} ELSE len(regexp_extract_all(coalesce({x}, ''), '{E.LATIN}', 0)) END"
    return f"CASE WHEN {letters} = 0 THEN 0.0 ELSE {ins} / {letters} END"


@query("e5_script_check", f"""
SELECT doc_id, lang, round({_duck_script('text', 'lang')}, 6) AS script_share, {_duck_script('text', 'lang')} >= 0.6 AS script_ok
FROM documents
""")
def e5_script_check(spark, sf):
    d = read_table(spark, sf, "documents")
    return E.script_check(d, "text", "lang", 0.6).select("doc_id", "lang", r6("script_share").alias("script_share"),
                                                          "script_ok")


_LINES = "split_part(text, chr(10), 1) AS l1, split_part(text, chr(10), 2) AS l2"


@query("e6_back_translation_pass", f"""
WITH p AS (SELECT lang AS language, list_distinct({D.tokens('l1')}) AS a, list_distinct({D.tokens('l2')}) AS b FROM (SELECT lang, {_LINES} FROM documents)),
j AS (SELECT language, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0
  ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS jaccard FROM p)
SELECT language, count(*) AS checked, round(avg(CASE WHEN jaccard >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate,
  round(avg(jaccard), 6) AS mean_jaccard FROM j GROUP BY language
""")
def e6_back_translation_pass(spark, sf):
    # Stand-in pairs: a document's first line as the original, its second line as
    # the back-translation.
    d = read_table(spark, sf, "documents").select(
        F.col("lang").alias("language"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("l1"),
        F.split_part("text", F.lit("\n"), F.lit(2)).alias("l2"))
    r = E.back_translation_pass(d, "l1", "l2", "language", 0.5)
    return r.select("language", "checked", r6("pass_rate").alias("pass_rate"), r6("mean_jaccard").alias("mean_jaccard"))


@query("e7_tokens_preserved", f"""
WITH p AS (SELECT doc_id, list_distinct(regexp_extract_all(l1, '{E.ENTITY}', 0)) AS s, regexp_extract_all(text, '{E.ENTITY}', 0) AS d
  FROM (SELECT doc_id, text, {_LINES} FROM documents))
SELECT doc_id, array_to_string(list_sort(list_filter(s, lambda x: NOT list_contains(d, x))), ',') AS missing_tokens,
  len(list_filter(s, lambda x: NOT list_contains(d, x))) = 0 AS preserved FROM p
""")
def e7_tokens_preserved(spark, sf):
    # Source: the title line; target: the whole text.
    d = read_table(spark, sf, "documents").select("doc_id", "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("l1"))
    r = E.tokens_preserved(d, "l1", "text")
    return r.select("doc_id", F.array_join(F.array_sort("missing_tokens"), ",").alias("missing_tokens"), "preserved")


_TPL_CASE = "CASE " + " ".join(f"WHEN category_slug = '{c}' THEN '{t}'" for c, t in E.TEMPLATES.items()) + " ELSE 'general' END"


@query("e8_assign_template", with_views(f"""
SELECT a.article_id, a.category_slug, {_TPL_CASE} AS template,
  'hsl(' || CAST(CAST(floor((c.display_order - 1) * 360 / 19) AS INTEGER) AS VARCHAR) || ',70%,45%)' AS badge_color
FROM articles a LEFT JOIN categories c USING (category_slug)
""", "articles", "categories"))
def e8_assign_template(spark, sf):
    a = fx.articles(spark, sf).select("article_id", "category_slug")
    return E.assign_template(a, E.template_dim(spark)).select("article_id", "category_slug", "template", "badge_color")


@query("e11_image_or_placeholder", with_views(f"""
SELECT article_id, 'placeholders/' || ({_TPL_CASE}) || '.png' AS snap_image, true AS is_placeholder FROM articles
""", "articles"))
def e11_image_or_placeholder(spark, sf):
    a = E.assign_template(fx.articles(spark, sf).select("article_id", "category_slug"), E.template_dim(spark))
    return E.image_or_placeholder(a.withColumn("image_url", F.lit(None).cast("string"))).select(
        "article_id", "snap_image", "is_placeholder")


@query("e12_uncached_images", """
SELECT DISTINCT url FROM (SELECT regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || '/favicon.ico' AS url FROM pages)
WHERE url NOT IN (SELECT regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || '/favicon.ico' FROM pages
  WHERE starts_with(url, 'https://'))
""")
def e12_uncached_images(spark, sf):
    # Fallback images (site icons) of every page; the cache already holds the
    # icons of the pages fetched over https.
    p = read_table(spark, sf, "pages")
    icon = F.concat(F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.lit("/favicon.ico"))
    urls = p.select(icon.alias("url"))
    cache = p.where(F.col("url").startswith("https://")).select(icon.alias("url"))
    return E.uncached_images(urls, cache)


def _hl_duck():
    parts = " ".join(f"WHEN tpl = '{t}' THEN regexp_extract_all(body, '{D._q(p)}', 0)" for t, p in E.HIGHLIGHTS.items())
    return f"CASE {parts} ELSE [] END"


@query("e13_highlights", with_views(f"""
SELECT article_id, tpl AS template, array_to_string({_hl_duck()}, '|') AS highlights FROM (
  SELECT article_id, regexp_extract(content, '\\n([\\s\\S]*)$', 1) AS body, {_TPL_CASE} AS tpl FROM articles)
""", "articles"))
def e13_highlights(spark, sf):
    a = E.assign_template(_bodies(spark, sf).select("article_id", "category_slug", "body"), E.template_dim(spark))
    h = E.highlights(a, "body", "template")
    return h.select("article_id", "template", F.array_join("highlights", "|").alias("highlights"))


@query("e9_build_snaps")
def e9_build_snaps(spark, sf):
    """Rows-only: one snap per article in its own language from the E1 summary;
    an article without a summary gives no snap."""
    a = E.assign_template(fx.articles(spark, sf).select("article_id", "category_slug", "source_name", "title", "language"),
                          E.template_dim(spark))
    a = E.image_or_placeholder(a.withColumn("image_url", F.lit(None).cast("string")))
    stories = a.select(F.col("article_id").alias("story_id"), "snap_image", "source_name", "template")
    tr = _summaries(spark, sf).where(F.col("summary").isNotNull()).join(a.select("article_id", "title", "language"), "article_id").select(
        F.col("article_id").alias("story_id"), "language", F.col("title").alias("headline"), F.col("summary").alias("body"))
    return E.build_snaps(stories, tr)

