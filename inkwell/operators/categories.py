"""Category assignment (B4): the URL's path by a source's prefixes, then keywords of the text, then the source's default."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import col_of, tokens
from inkwell.session import sized_broadcast

# The topics that describe each category, in display order. Up to two words each.
KEYWORDS = {
    "national": ("india", "domestic news", "governance", "policy"),
    "international": ("global news", "foreign affairs", "geopolitics"),
    "politics": ("elections", "parties", "parliament", "state politics"),
    "business": ("corporate", "startups", "economy", "gdp", "trade"),
    "finance": ("markets", "stocks", "mutual funds", "crypto", "rbi", "banking"),
    "sports": ("cricket", "football", "olympics", "ipl", "kabaddi"),
    "technology": ("ai", "gadgets", "apps", "internet", "social media"),
    "science": ("space", "research", "discoveries", "isro"),
    "automobile": ("cars", "bikes", "evs", "launches", "reviews"),
    "education": ("exams", "results", "universities", "nep", "scholarships"),
    "health": ("medical", "fitness", "diseases", "pharma"),
    "entertainment": ("bollywood", "ott", "music", "celebrities", "tv"),
    "lifestyle": ("food", "travel", "fashion", "relationships", "wellness"),
    "crime": ("law", "court verdicts", "scams", "cybercrime"),
    "environment": ("climate", "pollution", "wildlife", "disasters", "weather"),
    "jobs": ("government jobs", "sarkari naukri", "recruitment"),
    "defence": ("military", "armed forces", "defence deals", "border security"),
    "real_estate": ("property", "housing", "rera", "smart cities"),
    "opinion": ("editorials", "columns", "analysis", "debates"),
}
DEFAULT = "national"


def url_path(url) -> Column:
    """The path of a URL, from its first slash to the query or fragment; '/' where there is none."""
    path = F.regexp_extract(col_of(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def prefix_category(path: Column, rules: Column) -> Column:
    """The slug of the longest prefix of ``path`` among ``rules``, an array of (length, prefix, slug), longest first."""
    return F.get(F.filter(rules, lambda r: path.startswith(r["prefix"])), F.lit(0))["category_slug"]


def with_keyword_category(df: DataFrame, name: str, text, keywords: Mapping[str, Sequence[str]] = KEYWORDS, needed: Column | None = None) -> DataFrame:
    """``df`` with the category ``name`` that has the most different keywords in ``text``; the earlier category of equal ones, null
    for none and where ``needed`` is false.

    The text's words and pairs of words are cut down to those that are keywords in one pass over hashes; what is
    left has no more entries than there are keywords. Words and what is left are columns of their own, which Spark computes once a row.
    """
    every = F.array(*(F.lit(k) for words in keywords.values() for k in words))
    words = tokens(text) if needed is None else F.when(needed, tokens(text))
    pairs = F.zip_with(F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0))), F.col("_words"), lambda b, a: F.concat_ws(" ", a, b))
    df = df.withColumn("_words", words).withColumn("_found", F.array_intersect(F.concat("_words", pairs), every))
    return df.withColumn(name, F.when(F.size("_found") > 0, _best(F.col("_found"), keywords))).drop("_words", "_found")


def _best(found: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """The first category by number of keywords in ``found``."""
    scored = F.array(*(F.struct(F.size(F.array_intersect(found, F.array(*map(F.lit, words)))).alias("n"), F.lit(-i).alias("place"),
                                F.lit(slug).alias("slug")) for i, (slug, words) in enumerate(keywords.items())))
    return F.array_max(scored)["slug"]


def assign_category(articles: DataFrame, rules: DataFrame, defaults: DataFrame, keywords: Mapping[str, Sequence[str]] = KEYWORDS,
                    default: str = DEFAULT) -> DataFrame:
    """``articles`` (source_key, url, content, ...) with ``category_slug`` and ``category_by``, which says what decided.

    ``rules``: source_key, prefix, category_slug, one row for each prefix of a source's map; of the prefixes that a
    path starts with the longest wins, of equal ones the first slug. ``defaults``: source_key, category_slug. A source without
    rules goes straight to the keywords; without a default it gets ``default``. Configuration is one row a
    source when it meets the articles, so a source with a third of all articles needs no shuffle by source:
    the join is broadcast where the configuration is counted to be small, and split where it is skewed.
    """
    by_length = F.struct((-F.length("prefix")).alias("length"), "prefix", "category_slug")
    r = rules.where(F.col("prefix").isNotNull()).groupBy("source_key").agg(F.sort_array(F.collect_set(by_length)).alias("_rules"))
    d = defaults.groupBy("source_key").agg(F.min("category_slug").alias("_default"))
    config = r.join(d, "source_key", "full_outer")
    a = articles.join(sized_broadcast(config), "source_key", "left")
    a = a.withColumn("_prefix", prefix_category(url_path("url"), F.col("_rules")))
    a = with_keyword_category(a, "_keyword", "content", keywords, F.col("_prefix").isNull())
    by = F.when(F.col("_prefix").isNotNull(), "prefix").when(F.col("_keyword").isNotNull(), "keyword").otherwise("default")
    return a.withColumn("category_slug", F.coalesce("_prefix", "_keyword", "_default", F.lit(default))).withColumn(
        "category_by", by).select(*articles.columns, "category_slug", "category_by")
