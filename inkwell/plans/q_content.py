"""Registered queries: parse/normalise (B*) and quality filtering (C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions.text import canonical_url, clean_text
from inkwell.operators import parse as B
from inkwell.operators import quality as C
from inkwell.operators.ingest import to_articles
from inkwell.operators.langs import SCRIPT_RANGES, STOPWORDS
from inkwell.plans import duck_exprs as D
from inkwell.plans.catalog import query, r6
from inkwell.plans.oracle_views import with_views
from inkwell.sources import fixtures as fx
from inkwell.sources.tables import read_table

AS_OF = fx.AS_OF
TS = "TIMESTAMP '2024-01-31 00:00:00'"


def _pages(spark, sf):
    return read_table(spark, sf, "pages")


# ---------------------------------------------------------------- B1 / B2 / B3
@query("b1_extract_text", f"SELECT page_id, {D.html_to_text('html')} AS text FROM pages")
def b1_extract_text(spark, sf):
    return B.extract_text(_pages(spark, sf), "html").select("page_id", "text")


def _duck_meta(x):
    from inkwell.operators.parse import META_AUTHOR, META_H1, META_TAG, META_TITLE
    q = D._q
    title_raw = (f"coalesce(CASE WHEN trim(regexp_extract({x}, '{q(META_TITLE)}', 1)) <> '' THEN regexp_extract({x}, '{q(META_TITLE)}', 1) END, "
                 f"CASE WHEN trim(regexp_extract({x}, '{q(META_H1)}', 1)) <> '' THEN regexp_extract({x}, '{q(META_H1)}', 1) END)")
    t = f"regexp_replace({title_raw}, '<[^>]*>', ' ', 'g')"
    from inkwell.functions.html import ENTITIES
    for ent, ch in ENTITIES:
        t = f"replace({t}, '{q(ent)}', '{q(ch)}')"
    title = D.clean_text(t)
    a = f"regexp_extract({x}, '{q(META_AUTHOR)}', 1)"
    for ent, ch in ENTITIES:
        a = f"replace({a}, '{q(ent)}', '{q(ch)}')"
    a = D.clean_text(a)
    author = f"CASE WHEN trim({a}) <> '' THEN {a} END"
    tags = (f"array_to_string(list_filter(list_transform(flatten(list_transform(regexp_extract_all({x}, '{q(META_TAG)}', 1), "
            f"lambda t: string_split(t, ','))), lambda t: trim(t)), lambda t: t <> ''), ',')")
    return title, author, tags


_T, _A, _TG = _duck_meta("html")


@query("b2_extract_meta", f"SELECT page_id, {_T} AS title, {_A} AS author, {_TG} AS tags FROM pages")
def b2_extract_meta(spark, sf):
    m = B.extract_meta(_pages(spark, sf))
    return m.select("page_id", "title", "author", F.array_join("tags", ",").alias("tags"))


@query("b3_lead_image", """
SELECT page_id, coalesce(og, img, thumb) AS image_url,
  CASE WHEN og IS NOT NULL THEN 'og' WHEN img IS NOT NULL THEN 'img' WHEN thumb IS NOT NULL THEN 'thumbnail' END AS image_origin
FROM (SELECT page_id,
  nullif(trim(regexp_extract(html, '(?is)<meta[^>]*property="og:image"[^>]*content="([^"]*)"', 1)), '') AS og0,
  CASE WHEN og0 IS NOT NULL THEN regexp_extract(html, '(?is)<meta[^>]*property="og:image"[^>]*content="([^"]*)"', 1) END AS og,
  CASE WHEN trim(regexp_extract(list_filter(regexp_extract_all(html, '(?is)<img[^>]*>', 0),
      lambda t: coalesce(TRY_CAST(regexp_extract(t, '(?is)width="?([0-9]+)', 1) AS INTEGER), 0) >= 300)[1], '(?is)src="([^"]*)"', 1)) <> ''
    THEN regexp_extract(list_filter(regexp_extract_all(html, '(?is)<img[^>]*>', 0),
      lambda t: coalesce(TRY_CAST(regexp_extract(t, '(?is)width="?([0-9]+)', 1) AS INTEGER), 0) >= 300)[1], '(?is)src="([^"]*)"', 1) END AS img,
  coalesce(
    CASE WHEN trim(regexp_extract(html, '(?is)<meta[^>]*name="thumbnail"[^>]*content="([^"]*)"', 1)) <> ''
      THEN regexp_extract(html, '(?is)<meta[^>]*name="thumbnail"[^>]*content="([^"]*)"', 1) END,
    CASE WHEN trim(regexp_extract(html, '(?is)<link[^>]*rel="(?:icon|shortcut icon|apple-touch-icon)"[^>]*href="([^"]*)"', 1)) <> ''
      THEN regexp_extract(html, '(?is)<link[^>]*rel="(?:icon|shortcut icon|apple-touch-icon)"[^>]*href="([^"]*)"', 1) END) AS thumb
  FROM pages)
""")
def b3_lead_image(spark, sf):
    return B.lead_image(_pages(spark, sf)).select("page_id", "image_url", "image_origin")


# ---------------------------------------------------------------- B5 / B6
def _duck_detect(x):
    letters = f"len(regexp_extract_all(coalesce({x}, ''), '\\p{{L}}', 0))"
    toks = D.tokens(x)
    parts = []
    for lang, rng in SCRIPT_RANGES.items():
        parts.append(f"WHEN {letters} > 0 AND len(regexp_extract_all(coalesce({x}, ''), '{rng}', 0)) * 2 >= {letters} THEN '{lang}'")
    counts = {lang: f"len(list_filter({toks}, lambda w: list_contains([{', '.join(D._q_lit(s) for s in ws)}], w)))"
              for lang, ws in STOPWORDS.items()}
    langs = list(STOPWORDS)
    for i, lang in enumerate(langs):
        conds = [f"{counts[lang]} > 0"]
        for j, other in enumerate(langs):
            if other != lang:
                conds.append(f"{counts[lang]} {'>' if j < i else '>='} {counts[other]}")
        parts.append(f"WHEN {' AND '.join(conds)} THEN '{lang}'")
    return "CASE " + " ".join(parts) + " ELSE 'und' END"


@query("b5_detect_language", with_views(f"""
SELECT article_id, language, {_duck_detect('content')} AS detected_language FROM articles
""", "articles"))
def b5_detect_language(spark, sf):
    a = fx.articles(spark, sf).select("article_id", "language", "content")
    return B.detect_language(a, "content").select("article_id", "language", "detected_language")


@query("b6_language_mismatch", with_views(f"""
SELECT language AS declared, detected_language, count(*) AS articles, count(*) FILTER (WHERE mismatch) AS mismatches FROM (
  SELECT language, {_duck_detect('content')} AS detected_language,
    {_duck_detect('content')} <> language AS mismatch FROM articles) GROUP BY language, detected_language
""", "articles"))
def b6_language_mismatch(spark, sf):
    a = B.detect_language(fx.articles(spark, sf).select("article_id", "language", "content"), "content")
    m = B.language_mismatch(a, None, expected="language")
    return m.groupBy(F.col("language").alias("declared"), "detected_language").agg(
        F.count("*").alias("articles"), F.count_if("language_mismatch").alias("mismatches"))


# ---------------------------------------------------------------- B7 / B8 / B9 / B10 / B11
@query("b7_parse_time", """
SELECT event_id, date_trunc('second', ts) AS rfc822_ts, date_trunc('second', ts) AS iso_ts, date_trunc('second', ts) AS plain_ts
FROM events
""")
def b7_parse_time(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "ts")
    # Render each timestamp as an RFC 822, ISO 8601 and plain string, then parse back.
    s = ev.select("event_id",
                  F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss 'GMT'").alias("rfc"),
                  F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("iso"),
                  F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("plain"))
    return s.select("event_id", B.parse_time("rfc").alias("rfc822_ts"), B.parse_time("iso").alias("iso_ts"),
                    B.parse_time("plain").alias("plain_ts"))


@query("b8_repair_encoding", "SELECT doc_id, text AS repaired, true AS valid_utf8 FROM documents")
def b8_repair_encoding(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return d.select("doc_id", B.repair_encoding("raw").alias("repaired"),
                    F.try_validate_utf8(F.decode("raw", "UTF-8")).isNotNull().alias("valid_utf8"))


@query("b9_clean_text", f"SELECT doc_id, {D.clean_text('text')} AS clean FROM documents")
def b9_clean_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", clean_text("text").alias("clean"))


@query("b10_completeness", f"""
SELECT doc_id, {D.word_count('text')} AS word_count, {D.word_count('text')} < 100 AS incomplete FROM documents
""")
def b10_completeness(spark, sf):
    return B.completeness(read_table(spark, sf, "documents"), "text").select("doc_id", "word_count", "incomplete")


@query("b11_canonical_url", f"""
SELECT page_id, url, {D.canonical_url('url')} AS canonical_url, {D.host('url')} AS host FROM pages
""")
def b11_canonical_url(spark, sf):
    return B.with_canonical_url(_pages(spark, sf).select("page_id", "url")).select(
        "page_id", "url", "canonical_url", "host")


# ---------------------------------------------------------------- B13 / B14 / B15
@query("b13_to_articles", with_views(f"""
SELECT {D.canonical_url('url')} AS url, {_T} AS title, {D.html_to_text('html')} AS content, NULL AS language
FROM pages
UNION ALL
SELECT NULL AS url, title, content, language FROM articles
""", "articles"))
def b13_to_articles(spark, sf):
    p = B.extract_meta(B.extract_text(_pages(spark, sf), "html", "content")).select(
        canonical_url("url").alias("url"), "title", "content")
    a = fx.articles(spark, sf).select("title", "content", "language", "source_name", "category_slug", "publish_time")
    return to_articles(p, a).select("url", "title", "content", "language")


@query("b14_time_ago", with_views(f"""
SELECT article_id, publish_time, CASE WHEN s < 60 THEN 'just now'
  WHEN s < 3600 THEN CAST(s // 60 AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(s // 3600 AS BIGINT) || 'h ago'
  WHEN s < 604800 THEN CAST(s // 86400 AS BIGINT) || 'd ago' ELSE CAST(s // 604800 AS BIGINT) || 'w ago' END AS time_ago
FROM (SELECT article_id, publish_time, date_diff('second', publish_time, {TS}) AS s FROM articles)
""", "articles"))
def b14_time_ago(spark, sf):
    a = fx.articles(spark, sf).select("article_id", "publish_time")
    return B.with_time_ago(a, AS_OF)


_LINKS = f"""
WITH h AS (SELECT url, trim(unnest(regexp_extract_all(html, '(?is)<a[^>]*href="([^"]*)"', 1))) AS href FROM pages),
a AS (SELECT CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN href
  WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) || ':' || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href
  WHEN regexp_matches(href, '^(#|mailto:|javascript:|tel:)') OR href = '' THEN NULL
  ELSE CASE WHEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)', 1) = ''
    THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || '/'
    ELSE regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)', 1) END || href END AS abs FROM h)
SELECT DISTINCT {D.canonical_url('abs')} AS canonical_url FROM a WHERE abs IS NOT NULL
  AND {D.canonical_url('abs')} NOT IN (SELECT {D.canonical_url('url')} FROM pages)
"""


@query("b15_extract_links", _LINKS)
def b15_extract_links(spark, sf):
    pages = _pages(spark, sf)
    stored = pages.select(canonical_url("url").alias("canonical_url"))
    return B.extract_links(pages.select("url", "html"), stored)


# ---------------------------------------------------------------- C1..C8
def _duck_assess_ctes():
    toks_t = D.tokens("title")
    toks_b = D.tokens("body")
    wc = D.word_count("body")
    n = 8
    sh = (f"list_distinct(CASE WHEN len(tok) >= {n} THEN list_transform(range(1, len(tok) - {n} + 2), "
          f"lambda i: array_to_string(tok[i:i + {n - 1}], ' ')) ELSE [] END)")
    sentences = "list_filter(regexp_split_to_array(coalesce(body, ''), '[.!?]+\\s+'), lambda s: trim(s) <> '')"
    lines = "list_filter(list_transform(string_split(coalesce(body, ''), chr(10)), lambda s: trim(s)), lambda s: s <> '')"
    wcs = D.word_count("s")
    return f"""
a0 AS (SELECT a.article_id, a.title, a.content, a.source_name, a.publish_time, a.language, a.category_slug,
  regexp_extract(a.content, '\\n([\\s\\S]*)$', 1) AS body, coalesce(s.reliability_score, 1.0) AS reliability
  FROM articles a LEFT JOIN sources s ON a.source_name = s.source_name),
a1 AS (SELECT *, {wc} AS body_words,
  CASE WHEN len(list_distinct({toks_t})) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({toks_t}), {toks_b})) / len(list_distinct({toks_t})) END AS coherence,
  len(regexp_extract_all(coalesce(title, ''), '\\p{{L}}', 0)) AS t_letters,
  len(regexp_extract_all(coalesce(title, ''), '\\p{{Lu}}', 0)) AS t_upper,
  {sentences} AS sentences, {lines} AS lines FROM a0),
a2 AS (SELECT *,
  0.3 * least(body_words / 400.0, 1.0) + 0.3 * coherence + 0.2 * reliability + 0.2 * CASE WHEN body_words >= 100 THEN 1.0 ELSE 0.0 END AS quality_score,
  (regexp_matches(coalesce(title, ''), '{D._q(C.CLICKBAIT_PATTERN)}') OR regexp_matches(coalesce(title, ''), '[!?]{{2,}}')
    OR (t_letters >= 10 AND t_upper / t_letters > 0.5)) AND body_words < 300 AS clickbait,
  CASE WHEN len(sentences) = 0 THEN 0.0 ELSE len(list_filter(sentences, lambda s: {wcs} >= 8)) / len(sentences) END AS long_sentence_share,
  CASE WHEN len(lines) = 0 THEN 0.0 ELSE len(list_distinct(lines)) / len(lines) END AS unique_line_ratio,
  regexp_matches(lower(coalesce(content, '')), '(sponsored|partner content|advertorial)') AS sponsored FROM a1),
a3 AS (SELECT *, long_sentence_share >= 0.3 AND unique_line_ratio >= 0.5 AS meaningful FROM a2),
dtok AS (SELECT article_id, {D.tokens('content')} AS tok FROM articles),
dsh AS (SELECT article_id, {sh} AS shs FROM dtok),
ds AS (SELECT article_id, unnest(shs) AS sh FROM dsh),
tot AS (SELECT article_id, len(shs) AS n_shingles FROM dsh),
cs AS (SELECT DISTINCT unnest({sh}) AS sh FROM (SELECT {D.tokens('text')} AS tok FROM benchmark)),
per AS (SELECT sh, count(*) AS n_docs FROM ds GROUP BY sh),
bp AS (SELECT tot.article_id, tot.n_shingles,
  CASE WHEN tot.n_shingles = 0 THEN 0.0 ELSE coalesce(h.corpus_hits, 0) / tot.n_shingles END AS corpus_share,
  CASE WHEN tot.n_shingles = 0 THEN 0.0 ELSE coalesce(h.repeated_hits, 0) / tot.n_shingles END AS repeated_share
  FROM tot LEFT JOIN (SELECT ds.article_id, count(*) FILTER (WHERE cs.sh IS NOT NULL) AS corpus_hits,
     count(*) FILTER (WHERE per.n_docs >= 5) AS repeated_hits
     FROM ds JOIN per ON ds.sh = per.sh LEFT JOIN cs ON ds.sh = cs.sh GROUP BY ds.article_id) h ON tot.article_id = h.article_id),
scored AS (SELECT a3.*, bp.n_shingles, bp.corpus_share, bp.repeated_share FROM a3 LEFT JOIN bp ON a3.article_id = bp.article_id),
gated AS (SELECT *, list_filter([CASE WHEN quality_score < 0.4 THEN 'low_score' END, CASE WHEN body_words < 100 THEN 'incomplete' END,
    CASE WHEN clickbait THEN 'clickbait' END, CASE WHEN sponsored THEN 'sponsored' END,
    CASE WHEN NOT meaningful THEN 'not_meaningful' END,
    CASE WHEN greatest(corpus_share, repeated_share) >= 0.5 THEN 'boilerplate' END], lambda r: r IS NOT NULL) AS reasons FROM scored)
"""


def _duck_assess(body: str) -> str:
    return with_views("WITH " + _duck_assess_ctes().strip() + "\n" + body, "articles", "sources")


def _assessed(spark, sf):
    a = fx.articles(spark, sf)
    corpus = read_table(spark, sf, "benchmark")
    return C.assess(a, fx.sources(spark, sf), corpus)


@query("c1_quality_score", _duck_assess("""
SELECT article_id, body_words, round(coherence, 6) AS coherence, reliability, round(quality_score, 6) AS quality_score FROM a3
"""))
def c1_quality_score(spark, sf):
    a = fx.articles(spark, sf).withColumn("body", C.body_of("content"))
    q = C.quality_score(a, fx.sources(spark, sf))
    return q.select("article_id", "body_words", r6("coherence").alias("coherence"), "reliability",
                    r6("quality_score").alias("quality_score"))


@query("c2_clickbait", _duck_assess("SELECT article_id, clickbait FROM a3"))
def c2_clickbait(spark, sf):
    a = fx.articles(spark, sf).withColumn("body", C.body_of("content"))
    return C.clickbait_flag(a).select("article_id", "clickbait")


@query("c3_meaningful", _duck_assess("""
SELECT article_id, round(long_sentence_share, 6) AS long_sentence_share, round(unique_line_ratio, 6) AS unique_line_ratio, meaningful FROM a3
"""))
def c3_meaningful(spark, sf):
    a = fx.articles(spark, sf).withColumn("body", C.body_of("content"))
    m = C.meaningful(a)
    return m.select("article_id", r6("long_sentence_share").alias("long_sentence_share"),
                    r6("unique_line_ratio").alias("unique_line_ratio"), "meaningful")


@query("c4_sponsored", _duck_assess("SELECT article_id, sponsored FROM a3"))
def c4_sponsored(spark, sf):
    return C.sponsored_flag(fx.articles(spark, sf)).select("article_id", "sponsored")


@query("c5_boilerplate", _duck_assess("""
SELECT article_id, n_shingles, round(corpus_share, 6) AS corpus_share, round(repeated_share, 6) AS repeated_share FROM bp
"""))
def c5_boilerplate(spark, sf):
    b = C.boilerplate_overlap(fx.articles(spark, sf), read_table(spark, sf, "benchmark"), n=8, min_docs=5,
                              id_col="article_id", text="content")
    return b.select("article_id", "n_shingles", r6("corpus_share").alias("corpus_share"),
                    r6("repeated_share").alias("repeated_share"))


@query("c6_quality_gate", _duck_assess("""
SELECT article_id, len(reasons) = 0 AS accepted, CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ';') END AS rejection_reason
FROM gated
"""))
def c6_quality_gate(spark, sf):
    accepted = F.size("reasons") == 0
    return C.tag_quality(_assessed(spark, sf)).select(
        "article_id", accepted.alias("accepted"),
        F.when(~accepted, F.array_join("reasons", ";")).alias("rejection_reason"))


@query("c7_rejections", _duck_assess("""
SELECT article_id, source_name, array_to_string(reasons, ';') AS rejection_reason, round(quality_score, 6) AS quality_score, publish_time
FROM gated WHERE len(reasons) > 0 ORDER BY publish_time DESC, article_id LIMIT 100
"""))
def c7_rejections(spark, sf):
    _, rej = C.quality_gate(_assessed(spark, sf))
    return C.rejections(rej, 100).withColumn("quality_score", r6("quality_score"))


@query("c8_rejection_summary", _duck_assess("""
SELECT source_name, reason, count(*) AS rejections,
  CASE WHEN source_name IS NULL THEN 'total' WHEN reason IS NULL THEN 'source' ELSE 'detail' END AS level
FROM (SELECT source_name, unnest(reasons) AS reason FROM gated WHERE len(reasons) > 0) GROUP BY ROLLUP (source_name, reason)
"""))
def c8_rejection_summary(spark, sf):
    _, rej = C.quality_gate(_assessed(spark, sf))
    return C.rejection_summary(rej)

