"""Summaries, translations and snaps (E1-E13): the table work around the model
steps (the language models themselves are not built)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import dealt_by_id, tokens, word_count
from inkwell.operators.langs import SCRIPT_RANGES
from inkwell.operators.quality import CLICKBAIT_PATTERN

TARGET_LANGUAGES = ("en", "hi", "ta", "te", "kn")
LATIN = r"[A-Za-z\x{00C0}-\x{024F}]"
# 19 categories → 8 snap templates (spec); other categories → general.
TEMPLATES = {"finance": "finance", "business": "finance", "sports": "sports", "entertainment": "entertainment",
             "politics": "politics", "national": "politics", "technology": "technology", "science": "technology",
             "crime": "crime", "defence": "crime", "education": "education", "jobs": "education"}
# Highlight patterns per template type.
HIGHLIGHTS = {
    "finance": r"[0-9]+(?:[.,][0-9]+)*%?",
    "sports": r"[0-9]+-[0-9]+",
    "politics": r'"[^"]+"',
    "technology": r"[0-9]+(?:\.[0-9]+)? ?(?:GB|MB|TB|GHz|MHz|mAh|MP|nm|%)",
}
ENTITY = r"[0-9]+(?:[.,][0-9]+)*|\p{Lu}\p{Ll}+"
SENTENCE_SPLIT = r"[.!?]+\s+"


def extractive_summary(df: DataFrame, id_col: str = "article_id", text: str = "body",
                       lo: int = 60, hi: int = 80) -> DataFrame:
    """Sentences scored by mean document term frequency of their words plus a
    position bonus 1/(1+pos); taken best-first while the running word total stays
    within ``hi``, then put back in document order; a sentence longer than ``hi`` can
    be in no summary and is passed over. ``lo`` is reported as ``meets_minimum``. The
    per-document selection is at most ``hi`` words, so the final collect per document
    is bounded. Every row of ``df`` gives a row: without a summary it is null, with
    ``reason`` no_text or long_sentences.
    """
    s = (dealt_by_id(df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")), "_id", "_text")
         .select("_id", F.posexplode(F.split("_text", SENTENCE_SPLIT)).alias("pos", "sentence"))
         .withColumn("sentence", F.trim("sentence")).where(F.col("sentence") != ""))
    # A sentence goes with the first of its words, or alone. All windows are on parts of an id's rows, which lie together.
    toks = s.select("_id", "pos", "sentence", F.posexplode_outer(tokens("sentence")).alias("_at", "term"))
    toks = toks.select("_id", "pos", "term", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("sentence")).alias("sentence"))
    tf = F.when(F.col("term").isNotNull(), F.count("*").over(Window.partitionBy("_id", "term")))
    mtf = F.avg("_tf").over(Window.partitionBy("_id", "pos"))
    s = (toks.select("_id", "pos", "sentence", tf.alias("_tf")).withColumn("_mtf", mtf).where(F.col("sentence").isNotNull())
         .withColumn("score", F.coalesce("_mtf", F.lit(0.0)) + F.lit(1.0) / (F.col("pos") + 1))
         .withColumn("words", word_count("sentence")))
    w = (Window.partitionBy("_id").orderBy(F.col("score").desc(), F.col("pos"))
         .rowsBetween(Window.unboundedPreceding, 0))
    fits = F.when(F.col("words") <= hi, F.col("words")).otherwise(0)
    chosen = F.when((F.col("words") <= hi) & (F.col("_cum") <= hi), F.struct("pos", "sentence"))
    agg = (s.withColumn("_cum", F.sum(fits).over(w)).withColumn("_in", chosen)
           .groupBy("_id").agg(F.array_sort(F.collect_list("_in")).alias("_s"),  # nulls aren't collected
                               F.coalesce(F.sum(F.when(F.col("_in").isNotNull(), F.col("words"))), F.lit(0)).alias("_words")))
    words = F.coalesce("_words", F.lit(0)).cast("bigint")
    return df.select(F.col(id_col).alias("_id")).join(agg, "_id", "left").select(
        F.col("_id").alias(id_col),
        F.when(F.size("_s") > 0, F.array_join(F.transform("_s", lambda x: x["sentence"]), ". ")).alias("summary"),
        words.alias("summary_words"), (words >= lo).alias("meets_minimum"),
        F.when(F.col("_s").isNull(), F.lit("no_text")).when(F.size("_s") == 0, F.lit("long_sentences")).alias("reason"))


def validate_summaries(df: DataFrame, summary: str = "summary", source: str = "title",
                       lo: int = 40, hi: int = 100, min_coverage: float = 0.5) -> DataFrame:
    """40-100 words, at least half of the source's key entities (numbers and
    capitalised words) present, and no clickbait phrasing. A null summary has no
    words and is not valid."""
    text = F.coalesce(F.col(summary), F.lit(""))
    ents = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(source), F.lit("")), F.lit(ENTITY), 0))
    got = F.array_intersect(ents, F.regexp_extract_all(text, F.lit(ENTITY), 0))
    cov = F.when(F.size(ents) == 0, F.lit(1.0)).otherwise(F.size(got) / F.size(ents))
    wc = word_count(text)
    return (df.withColumn("entity_coverage", cov)
            .withColumn("valid", (wc >= lo) & (wc <= hi) & (cov >= min_coverage) & ~text.rlike(CLICKBAIT_PATTERN)))


def retry_queue(results: DataFrame, key: str = "item_id", max_retries: int = 2) -> DataFrame:
    """Per item the latest result decides: success → done; failure with fewer
    than ``max_retries`` attempts → retry; otherwise dead letter."""
    agg = results.groupBy(key).agg(F.count("*").alias("attempts"),
                                   F.max_by("status", F.struct("attempt_ts", "attempt")).alias("last_status"))
    return agg.withColumn("queue", F.when(F.col("last_status") == "success", F.lit("done"))
                          .when(F.col("attempts") < max_retries, F.lit("retry")).otherwise(F.lit("dead_letter")))


def missing_translations(stories: DataFrame, snaps: DataFrame, langs=TARGET_LANGUAGES) -> DataFrame:
    """(story, language) pairs of the target languages with no snap yet."""
    want = stories.select("story_id", F.explode(F.array(*[F.lit(x) for x in langs])).alias("language"))
    return want.join(snaps.select("story_id", "language"), ["story_id", "language"], "left_anti")


def script_check(df: DataFrame, text: str, lang: str, min_share: float = 0.6) -> DataFrame:
    """E5: share of letters in the language's script (Indic block or Latin)."""
    t = F.coalesce(F.col(text), F.lit(""))
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    expr = None
    for lg, rng in SCRIPT_RANGES.items():
        cond = F.col(lang) == lg
        val = F.regexp_count(t, F.lit(rng))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    in_script = expr.otherwise(F.regexp_count(t, F.lit(LATIN)))
    share = F.when(letters == 0, F.lit(0.0)).otherwise(in_script / letters)
    return df.withColumn("script_share", share).withColumn("script_ok", share >= min_share)


def back_translation_pass(df: DataFrame, original: str, back: str, lang: str = "language",
                          threshold: float = 0.5) -> DataFrame:
    """Token Jaccard between original and back-translation; pass rate per language."""
    a, b = F.array_distinct(tokens(original)), F.array_distinct(tokens(back))
    u = F.size(F.array_union(a, b))
    jac = F.when(u == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / u)
    d = df.withColumn("jaccard", jac)
    return d.groupBy(lang).agg(F.count("*").alias("checked"),
                               F.avg((F.col("jaccard") >= threshold).cast("double")).alias("pass_rate"),
                               F.avg("jaccard").alias("mean_jaccard"))


def tokens_preserved(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Numbers and names of the source missing from the translation."""
    s = F.array_distinct(F.regexp_extract_all(F.col(src), F.lit(ENTITY), 0))
    d = F.regexp_extract_all(F.col(dst), F.lit(ENTITY), 0)
    miss = F.array_except(s, d)
    return df.withColumn("missing_tokens", miss).withColumn("preserved", F.size(miss) == 0)


def template_dim(spark) -> DataFrame:
    """E8 dimension: 19 categories → template and a badge colour from a rule
    (evenly spaced hues, one per category)."""
    from inkwell.sources.fixtures import CATEGORY_SLUGS
    rows = [(c, TEMPLATES.get(c, "general"), i + 1) for i, c in enumerate(CATEGORY_SLUGS)]
    d = spark.createDataFrame(rows, "category_slug string, template string, display_order int")
    hue = ((F.col("display_order") - 1) * 360 / 19).cast("int")
    return d.withColumn("badge_color", F.concat(F.lit("hsl("), hue.cast("string"), F.lit(",70%,45%)")))


def assign_template(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Template and colour by category (19-row dimension, broadcast); unknown → general."""
    j = df.join(F.broadcast(dim.select("category_slug", "template", "badge_color")), "category_slug", "left")
    return j.withColumn("template", F.coalesce("template", F.lit("general")))


def image_or_placeholder(df: DataFrame, image: str = "image_url") -> DataFrame:
    """The article's image, else its template's placeholder."""
    ph = F.concat(F.lit("placeholders/"), F.col("template"), F.lit(".png"))
    return df.withColumn("snap_image", F.coalesce(F.col(image), ph)).withColumn(
        "is_placeholder", F.col(image).isNull())


def uncached_images(urls: DataFrame, cache: DataFrame, key: str = "url") -> DataFrame:
    """Distinct image URLs not yet in the cache."""
    return urls.select(key).distinct().join(cache.select(key), key, "left_anti")


def highlights(df: DataFrame, text: str = "body", template: str = "template") -> DataFrame:
    """Template-specific highlights (numbers, scores, quotes, key stats)."""
    t = F.coalesce(F.col(text), F.lit(""))
    expr = None
    for tpl, pat in HIGHLIGHTS.items():
        cond = F.col(template) == tpl
        val = F.regexp_extract_all(t, F.lit(pat), 0)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return df.withColumn("highlights", expr.otherwise(F.array().cast("array<string>")))


def build_snaps(stories: DataFrame, translations: DataFrame) -> DataFrame:
    """One snap per story and language: headline, body, image, attribution."""
    s = stories.select("story_id", "snap_image", "source_name", "template")
    t = translations.select("story_id", "language", "headline", "body")
    return t.join(s, "story_id").select("story_id", "language", "headline", "body",
                                        F.col("snap_image").alias("image_path"),
                                        F.concat(F.lit("Source: "), F.col("source_name")).alias("source_attribution"),
                                        "template")


def validate_images(meta: DataFrame, min_side: int = 200, max_bytes: int = 500 * 1024) -> DataFrame:
    """Usable image = fetched ok, both sides >= 200 px; the 16:9 centre crop
    box and whether the source already fits the 500 KB budget."""
    w, h = F.col("width"), F.col("height")
    crop_w = F.least(w, F.floor(h * 16 / 9)).cast("int")
    crop_h = F.least(h, F.floor(w * 9 / 16)).cast("int")
    return (meta.withColumn("usable", (F.col("status") == "ok") & (w >= min_side) & (h >= min_side))
            .withColumn("crop_w", crop_w).withColumn("crop_h", crop_h)
            .withColumn("crop_x", ((w - crop_w) / 2).cast("int")).withColumn("crop_y", ((h - crop_h) / 2).cast("int"))
            .withColumn("within_budget", F.col("bytes") <= max_bytes))
