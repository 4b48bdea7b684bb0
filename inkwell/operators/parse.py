"""Parse and normalise (B1-B15): projections and scalar functions over pages and
articles. Everything is a JVM expression, so each operator is one narrow stage
(no shuffle) that whole-stage codegen fuses with the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import html as H
from inkwell.functions.text import canonical_url, clean_text, col_of, host_of, tokens, word_count
from inkwell.functions.time import time_ago

META_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
META_H1 = r"(?is)<h1[^>]*>(.*?)</h1>"
META_AUTHOR = r"(?is)<meta[^>]*name=\"author\"[^>]*content=\"([^\"]*)\""
META_TAG = r"(?is)<meta[^>]*(?:property=\"article:tag\"|name=\"keywords\")[^>]*content=\"([^\"]*)\""
OG_IMAGE = r"(?is)<meta[^>]*property=\"og:image\"[^>]*content=\"([^\"]*)\""
IMG_TAG = r"(?is)<img[^>]*>"
IMG_SRC = r"(?is)src=\"([^\"]*)\""
IMG_WIDTH = r"(?is)width=\"?([0-9]+)"
ICON = r"(?is)<link[^>]*rel=\"(?:icon|shortcut icon|apple-touch-icon)\"[^>]*href=\"([^\"]*)\""
THUMB = r"(?is)<meta[^>]*name=\"thumbnail\"[^>]*content=\"([^\"]*)\""
HREF = r"(?is)<a[^>]*href=\"([^\"]*)\""
LARGE_IMAGE_MIN_WIDTH = 300


def extract_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """B1: main article text from raw HTML."""
    return df.withColumn(out, H.html_to_text(html))


def _nonempty(c):
    return F.when(F.trim(c) != "", c)


def extract_meta(df: DataFrame, html: str = "html") -> DataFrame:
    """B2: title (<title>, else <h1>), author meta, tags (article:tag / keywords)."""
    h = F.col(html)
    title = F.coalesce(_nonempty(F.regexp_extract(h, META_TITLE, 1)), _nonempty(F.regexp_extract(h, META_H1, 1)))
    title = clean_text(H.unescape(F.regexp_replace(title, H.TAG, " ")))
    author = _nonempty(clean_text(H.unescape(F.regexp_extract(h, META_AUTHOR, 1))))
    raw_tags = F.regexp_extract_all(h, F.lit(META_TAG), 1)
    tags = F.filter(F.transform(F.flatten(F.transform(raw_tags, lambda t: F.split(t, ","))),
                                lambda t: F.trim(t)), lambda t: t != "")
    return df.withColumn("title", title).withColumn("author", author).withColumn("tags", tags)


def lead_image(df: DataFrame, html: str = "html") -> DataFrame:
    """Og:image, else the first <img> at least 300 px wide, else thumbnail/icon."""
    h = F.col(html)
    og = _nonempty(F.regexp_extract(h, OG_IMAGE, 1))
    imgs = F.regexp_extract_all(h, F.lit(IMG_TAG), 0)
    large = F.filter(imgs, lambda t: F.coalesce(
        F.regexp_extract(t, IMG_WIDTH, 1).try_cast("int"), F.lit(0)) >= LARGE_IMAGE_MIN_WIDTH)
    img = _nonempty(F.regexp_extract(F.try_element_at(large, F.lit(1)), IMG_SRC, 1))
    thumb = F.coalesce(_nonempty(F.regexp_extract(h, THUMB, 1)), _nonempty(F.regexp_extract(h, ICON, 1)))
    return (df.withColumn("image_url", F.coalesce(og, img, thumb))
            .withColumn("image_origin", F.when(og.isNotNull(), F.lit("og"))
                        .when(img.isNotNull(), F.lit("img"))
                        .when(thumb.isNotNull(), F.lit("thumbnail"))))


def completeness(df: DataFrame, text: str = "content", min_words: int = 100) -> DataFrame:
    """Word count and an incomplete flag (< min_words)."""
    return (df.withColumn("word_count", word_count(text))
            .withColumn("incomplete", F.col("word_count") < min_words))


def with_canonical_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Canonical URL and host."""
    return df.withColumn("canonical_url", canonical_url(url)).withColumn("host", host_of(url))


def with_time_ago(df: DataFrame, as_of, ts: str = "publish_time") -> DataFrame:
    """B14: 'time ago' text relative to as_of."""
    return df.withColumn("time_ago", time_ago(F.col(ts), as_of))


# The zone names of RFC 822 and their offsets.
RFC822_ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400",
                "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def parse_time(c, formats=None):
    """First format that parses wins (ISO 8601, RFC 822 and custom patterns).

    The weekday prefix ('Tue, ') is stripped first: ``EEE`` is not accepted by
    the Spark 4 datetime parser. The zone names of RFC 822 become offsets.
    """
    s = F.trim(col_of(c))
    s = F.regexp_replace(s, r"^[A-Za-z]{3},\s*", "")
    for zone, offset in RFC822_ZONES.items():
        s = F.regexp_replace(s, rf"(:\d{{2}})\s+{zone}$", f"$1 {offset}")
    fmts = formats or ["yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss",
                       "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in fmts]).cast("timestamp_ntz")


def repair_encoding(b, charset: str | None = None):
    """Bytes to text: valid UTF-8 decodes as UTF-8, otherwise as ``charset``
    (ISO-8859-1 by default, which maps every byte)."""
    raw = col_of(b)
    # A cast takes the bytes as they are; decode() would fail the job on the first invalid one.
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, charset or "ISO-8859-1"))


def detect_language(df: DataFrame, text: str = "content", out: str = "detected_language") -> DataFrame:
    """Unicode script share for hi/ta/te/kn; stop-word share for Latin scripts.

    Counts stay inside the row (regexp_count, filter over the token array), so
    detection is a narrow map stage with no shuffle, whatever the corpus size.
    """
    from inkwell.operators.langs import SCRIPT_RANGES, STOPWORDS
    t = F.coalesce(F.col(text), F.lit(""))
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    toks = tokens(t)
    script_counts = {lang: F.regexp_count(t, F.lit(rng)) for lang, rng in SCRIPT_RANGES.items()}
    stop_counts = {lang: _count_in(toks, words) for lang, words in STOPWORDS.items()}
    d = df
    for lang, cnt in script_counts.items():
        d = d.withColumn(f"_s_{lang}", cnt)
    for lang, cnt in stop_counts.items():
        d = d.withColumn(f"_w_{lang}", cnt)
    d = d.withColumn("_letters", letters)
    # Script languages first (share >= 0.5 of letters), in a fixed order.
    script = None
    for lang in SCRIPT_RANGES:
        cond = (F.col("_letters") > 0) & (F.col(f"_s_{lang}") * 2 >= F.col("_letters"))
        script = F.when(cond, F.lit(lang)) if script is None else script.when(cond, F.lit(lang))
    # Latin: most stop-word hits; ties go to the earlier language in STOPWORDS order.
    best = None
    langs = list(STOPWORDS)
    for i, lang in enumerate(langs):
        c = F.col(f"_w_{lang}")
        cond = F.lit(True)
        for j, other in enumerate(langs):
            if other == lang:
                continue
            o = F.col(f"_w_{other}")
            cond = cond & ((c > o) if j < i else (c >= o))
        best = F.when(cond & (c > 0), F.lit(lang)) if best is None else best.when(cond & (c > 0), F.lit(lang))
    result = script.when(F.lit(True), best) if script is not None else best
    drop = [c for c in d.columns if c.startswith("_s_") or c.startswith("_w_")] + ["_letters"]
    return d.withColumn(out, F.coalesce(result, F.lit("und"))).drop(*drop)


def _count_in(toks, words):
    """Number of tokens (with repeats) that are in ``words``."""
    vocab = F.array(*[F.lit(x) for x in words])
    return F.size(F.filter(toks, lambda w: F.array_contains(vocab, w)))


def language_mismatch(df: DataFrame, sources: DataFrame | None = None, detected: str = "detected_language",
                      expected: str = "language") -> DataFrame:
    """Flag rows whose detected language differs from the source's language
    (``sources``: source_name, language) or, without sources, from ``expected``."""
    if sources is not None:
        s = sources.select("source_name", F.col("language").alias("_src_lang"))
        d = df.join(s, "source_name", "left")
        return d.withColumn("language_mismatch", F.col(detected) != F.col("_src_lang")).drop("_src_lang")
    return df.withColumn("language_mismatch", F.col(detected) != F.col(expected))


def extract_links(pages: DataFrame, stored: DataFrame | None = None, pattern: str | None = None) -> DataFrame:
    """Anchors of list pages, made absolute against the page URL, canonical,
    distinct, and not yet stored (``stored``: canonical_url)."""
    p = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("href"))
    origin = F.regexp_extract(F.col("url"), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(F.col("url"), r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    base_dir = F.regexp_extract(F.col("url"), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
    href = F.trim(F.col("href"))
    absolute = (F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), href)
                .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
                .when(href.startswith("/"), F.concat(origin, href))
                .when(href.rlike(r"^(#|mailto:|javascript:|tel:)") | (href == ""), F.lit(None))
                .otherwise(F.concat(F.when(base_dir == "", F.concat(origin, F.lit("/"))).otherwise(base_dir), href)))
    links = p.select(absolute.alias("abs")).where(F.col("abs").isNotNull())
    if pattern is not None:
        links = links.where(F.col("abs").rlike(pattern))
    out = links.select(canonical_url("abs").alias("canonical_url")).distinct()
    if stored is not None:
        out = out.join(stored.select("canonical_url"), "canonical_url", "left_anti")
    return out
