"""Quality filtering.

Per-article signals are row-local expressions (narrow, codegen'd). Only the
boilerplate check (C5) needs data from other rows; it shuffles 64-bit shingle
hashes, never the text, and pre-aggregates per (shingle, doc) before counting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import tokens, word_count

# Default score weights and thresholds.
WEIGHTS = {"length": 0.3, "coherence": 0.3, "reliability": 0.2, "completeness": 0.2}
FULL_LENGTH_WORDS = 400
MIN_WORDS = 100
THIN_BODY_WORDS = 300
QUALITY_THRESHOLD = 0.4
BOILERPLATE_SHARE = 0.5

# Sensational title patterns (case-insensitive).
CLICKBAIT_PATTERN = (r"(?i)(you won.t believe|won.t believe|what happened next|what happens next|shocking|"
                     r"will blow your mind|jaw.dropping|unbelievable|this is why|you need to know|"
                     r"doctors hate|gone wrong|must see|number [0-9]+ will)")
PUNCT_RUN = r"[!?]{2,}"
# Sponsored-content markers (spec).
SPONSOR_MARKERS = ("sponsored", "partner content", "advertorial")


def body_of(content: str = "content"):
    """Article body: the content after its first line (the first line is the title)."""
    text = F.col(content)
    at = F.instr(text, "\n")
    return F.when(at > 0, F.substr(text, at + 1)).when(text.isNotNull(), "")


def coherence(title, body):
    """Share of distinct title tokens that also occur in the body (0 for no tokens)."""
    tt = F.array_distinct(tokens(title))
    hit = F.size(F.array_intersect(tt, tokens(body)))
    return F.when(F.size(tt) == 0, F.lit(0.0)).otherwise(hit / F.size(tt))


def quality_score(df: DataFrame, sources: DataFrame | None = None, weights: dict | None = None,
                  title: str = "title", body: str = "body") -> DataFrame:
    """Score in [0, 1] = w1·min(words/400, 1) + w2·coherence + w3·reliability
    + w4·completeness (words >= 100). Reliability comes from the source dimension
    (default 1.0 for unknown sources)."""
    w = dict(WEIGHTS, **(weights or {}))
    d = df
    if sources is not None:
        d = d.join(sources.select("source_name", "reliability_score"), "source_name", "left")
    rel = F.coalesce(F.col("reliability_score"), F.lit(1.0)) if "reliability_score" in d.columns else F.lit(1.0)
    d = (d.withColumn("body_words", word_count(body))
         .withColumn("coherence", coherence(F.col(title), F.col(body)))
         .withColumn("reliability", rel))
    score = (F.lit(w["length"]) * F.least(F.col("body_words") / F.lit(float(FULL_LENGTH_WORDS)), F.lit(1.0))
             + F.lit(w["coherence"]) * F.col("coherence")
             + F.lit(w["reliability"]) * F.col("reliability")
             + F.lit(w["completeness"]) * F.when(F.col("body_words") >= MIN_WORDS, F.lit(1.0)).otherwise(F.lit(0.0)))
    return d.withColumn("quality_score", score)


def caps_share(title):
    letters = F.regexp_count(title, F.lit(r"\p{L}"))
    upper = F.regexp_count(title, F.lit(r"\p{Lu}"))
    return F.when(letters == 0, F.lit(0.0)).otherwise(upper / letters)


def clickbait_flag(df: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """Sensational title (pattern, >50% capitals over >= 10 letters, or a run of
    '!'/'?') with a thin body (< 300 words)."""
    t = F.coalesce(F.col(title), F.lit(""))
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    sensational = (t.rlike(CLICKBAIT_PATTERN) | t.rlike(PUNCT_RUN)
                   | ((letters >= 10) & (caps_share(t) > 0.5)))
    return df.withColumn("clickbait", sensational & (word_count(body) < THIN_BODY_WORDS))


def meaningful(df: DataFrame, body: str = "body", min_long_share: float = 0.3,
               min_unique_lines: float = 0.5, long_words: int = 8) -> DataFrame:
    """Meaningful content = share of sentences with >= 8 words at least 0.3 and
    share of distinct non-empty lines at least 0.5 (captions/ads-only bodies fail)."""
    b = F.coalesce(F.col(body), F.lit(""))
    sentences = F.filter(F.split(b, r"[.!?]+\s+"), lambda s: F.trim(s) != "")
    n_long = F.size(F.filter(sentences, lambda s: word_count(s) >= long_words))
    lines = F.filter(F.transform(F.split(b, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    long_share = F.when(F.size(sentences) == 0, F.lit(0.0)).otherwise(n_long / F.size(sentences))
    uniq = F.when(F.size(lines) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(lines)) / F.size(lines))
    return (df.withColumn("long_sentence_share", long_share).withColumn("unique_line_ratio", uniq)
            .withColumn("meaningful", (long_share >= min_long_share) & (uniq >= min_unique_lines)))


def sponsored_flag(df: DataFrame, text: str = "content", markers=SPONSOR_MARKERS) -> DataFrame:
    """C4: sponsored/partner/advertorial markers anywhere in the text."""
    pattern = "(" + "|".join(markers) + ")"
    return df.withColumn("sponsored", F.lower(F.coalesce(F.col(text), F.lit(""))).rlike(pattern))


def shingles(tok, n: int):
    """Distinct word n-gram hashes (xxhash64 of the tokens).

    ``tok`` must be an already projected token-array column: the lambda slices it
    once per position, so it must not re-tokenise the text each time.
    """
    t = F.col(tok) if isinstance(tok, str) else tok
    grams = F.when(F.size(t) >= n, F.transform(
        F.sequence(F.lit(0), F.size(t) - n), lambda i: F.xxhash64(F.slice(t, i + 1, n))))
    return F.array_distinct(F.coalesce(grams, F.array().cast("array<bigint>")))


def _doc_shingles(df: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    toks = df.select(F.col(id_col).alias("_id"), tokens(text).alias("_tok"))
    return toks.select("_id", shingles("_tok", n).alias("_sh"))


def boilerplate_overlap(docs: DataFrame, corpus: DataFrame | None, n: int = 8, min_docs: int = 5,
                        id_col: str = "doc_id", text: str = "text", corpus_text: str = "text") -> DataFrame:
    """Per document, the share of its distinct word n-grams found in the
    boilerplate corpus, and the share repeated in at least ``min_docs`` documents.

    Shingles are distinct per document and hashed to 64 bits, so counting a
    shingle's documents pre-aggregates in the map task. Only shingles that repeat
    or lie in the corpus are joined back on the hash.
    """
    base = _doc_shingles(docs, id_col, text, n)
    # explode_outer + null filter: a plain explode makes Catalyst infer a
    # ``size(...) > 0`` filter that re-inlines the tokeniser into the lambda.
    ds = base.select("_id", F.explode_outer("_sh").alias("sh")).where(F.col("sh").isNotNull())
    totals = base.select("_id", F.size("_sh").alias("n_shingles"))
    marks = (ds.groupBy("sh").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
             .select("sh", F.lit(True).alias("_repeated")))
    if corpus is not None:
        cs = (_doc_shingles(corpus.withColumn("_cid", F.lit(0)), "_cid", corpus_text, n)
              .select(F.explode_outer("_sh").alias("sh")).where(F.col("sh").isNotNull()).distinct().withColumn("_in_corpus", F.lit(True)))
        marks = marks.join(cs, "sh", "full_outer")
    else:
        marks = marks.withColumn("_in_corpus", F.lit(None).cast("boolean"))
    agg = ds.join(marks, "sh").groupBy("_id").agg(
        F.count_if(F.col("_in_corpus").isNotNull()).alias("corpus_hits"),
        F.count_if(F.col("_repeated").isNotNull()).alias("repeated_hits"))
    out = totals.join(agg, "_id", "left").select(
        F.col("_id").alias(id_col), "n_shingles",
        F.when(F.col("n_shingles") == 0, F.lit(0.0))
        .otherwise(F.coalesce("corpus_hits", F.lit(0)) / F.col("n_shingles")).alias("corpus_share"),
        F.when(F.col("n_shingles") == 0, F.lit(0.0))
        .otherwise(F.coalesce("repeated_hits", F.lit(0)) / F.col("n_shingles")).alias("repeated_share"))
    return out


def tag_quality(scored: DataFrame, threshold: float = QUALITY_THRESHOLD) -> DataFrame:
    """The reasons against each article in one array; an empty one accepts it
    (score >= threshold and no hard flag). Expects the columns of C1-C5
    (quality_score, clickbait, body_words, sponsored, meaningful, corpus_share,
    repeated_share)."""
    reasons = F.filter(F.array(
        F.when(F.col("quality_score") < threshold, F.lit("low_score")),
        F.when(F.col("body_words") < MIN_WORDS, F.lit("incomplete")),
        F.when(F.col("clickbait"), F.lit("clickbait")),
        F.when(F.col("sponsored"), F.lit("sponsored")),
        F.when(~F.col("meaningful"), F.lit("not_meaningful")),
        F.when(F.greatest(F.col("corpus_share"), F.col("repeated_share")) >= BOILERPLATE_SHARE,
               F.lit("boilerplate"))), lambda r: r.isNotNull())
    return scored.withColumn("reasons", reasons)


def quality_gate(scored: DataFrame, threshold: float = QUALITY_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """C6 split for two sinks: (accepted, rejected) with reasons. Reading both plans
    C1-C5 twice; where one frame will do, use tag_quality."""
    tagged = tag_quality(scored, threshold)
    accepted = tagged.where(F.size("reasons") == 0).drop("reasons")
    rejected = tagged.where(F.size("reasons") > 0).withColumn("rejection_reason", F.array_join("reasons", ";"))
    return accepted, rejected


def rejections(rejected: DataFrame, limit: int = 100) -> DataFrame:
    """Rejection log, newest first (publish time, then id), top ``limit``."""
    return (rejected.select("article_id", "source_name", "rejection_reason", "quality_score", "publish_time")
            .orderBy(F.col("publish_time").desc(), F.col("article_id")).limit(limit))


def rejection_summary(rejected: DataFrame) -> DataFrame:
    """Rejection counts by source and reason, with per-source and grand totals."""
    e = rejected.select("source_name", F.explode("reasons").alias("reason"))
    return (e.rollup("source_name", "reason").agg(F.count("*").alias("rejections"))
            .withColumn("level", F.when(F.col("source_name").isNull(), F.lit("total"))
                        .when(F.col("reason").isNull(), F.lit("source")).otherwise(F.lit("detail"))))


def assess(articles: DataFrame, sources: DataFrame | None, corpus: DataFrame | None,
           n: int = 8, min_docs: int = 5) -> DataFrame:
    """C1-C5 together on articles (article_id, title, content, source_name, ...)."""
    a = articles.withColumn("body", body_of("content"))
    a = quality_score(a, sources)
    a = clickbait_flag(a)
    a = meaningful(a)
    a = sponsored_flag(a)
    bp = boilerplate_overlap(articles, corpus, n=n, min_docs=min_docs, id_col="article_id", text="content")
    return a.join(bp, "article_id", "left")
