"""Trending and explore.

Top-k per group is always ``row_number() <= k`` over a window partitioned by the
group: Spark plans it as a partial WindowGroupLimit before the exchange, so a hot
group (one language holding a third of the articles) ships at most k rows per map
task instead of all its rows. Every ranking ends in a unique id tie-break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.time import age_seconds, in_window


def velocity(events: DataFrame, as_of, minutes: float = 60) -> DataFrame:
    """G1: interactions per minute over ``(as_of - minutes, as_of]`` per item."""
    return (events.where(in_window(F.col("ts"), as_of, minutes * 60))
            .groupBy("item_id")
            .agg(F.count("*").alias("interactions"))
            .withColumn("velocity", F.col("interactions") / F.lit(float(minutes))))


def top_k(df: DataFrame, group_cols, order_cols, k: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group (row_number; order_cols must end in a unique id)."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def trending(vel: DataFrame, articles: DataFrame, k: int = 10) -> DataFrame:
    """Top-k items by velocity per language."""
    a = articles.select("article_id", "language", "title", "category_slug")
    j = vel.join(a, vel.item_id == a.article_id, "inner").drop("item_id")
    return top_k(j, ["language"], [F.col("velocity").desc(), F.col("article_id")], k)


def category_counts(categories: DataFrame, articles: DataFrame, language: str) -> DataFrame:
    """Every category with its article count in ``language``; zeros included.

    Articles are aggregated first (partial aggregate, one row per category) and
    only then joined to the 19-row category dimension.
    """
    counts = (articles.where(F.col("language") == language)
              .groupBy("category_slug").agg(F.count("*").alias("article_count")))
    return (categories.join(counts, "category_slug", "left")
            .select("category_slug", "display_order",
                    F.coalesce("article_count", F.lit(0)).cast("bigint").alias("article_count")))


def top_per_category(articles: DataFrame, events: DataFrame, as_of, k: int = 5,
                     hours: float = 24) -> DataFrame:
    """Per (language, category) the top-k articles published in the last ``hours``,
    by interactions in the same window, then newest, then id."""
    recent = articles.where(in_window(F.col("publish_time"), as_of, hours * 3600)).select(
        "article_id", "language", "category_slug", "publish_time")
    hits = (events.where(in_window(F.col("ts"), as_of, hours * 3600))
            .groupBy("item_id").agg(F.count("*").alias("interactions")))
    j = (recent.join(hits, recent.article_id == hits.item_id, "left").drop("item_id")
         .withColumn("interactions", F.coalesce("interactions", F.lit(0))))
    return top_k(j, ["language", "category_slug"],
                 [F.col("interactions").desc(), F.col("publish_time").desc(), F.col("article_id")], k)


def breaking(articles: DataFrame, vel: DataFrame, as_of, threshold: float,
             minutes: float = 30) -> DataFrame:
    """Published at most ``minutes`` before as_of and velocity above threshold."""
    a = articles.where(in_window(F.col("publish_time"), as_of, minutes * 60)).select(
        "article_id", "language", "title", "category_slug", "publish_time")
    j = a.join(vel, a.article_id == vel.item_id, "inner").drop("item_id")
    return j.where(F.col("velocity") > threshold).withColumn(
        "age_seconds", age_seconds(F.col("publish_time"), as_of))


def explore(breaking_df: DataFrame, trending_df: DataFrame, top_cat_df: DataFrame) -> DataFrame:
    """Breaking ∪ trending ∪ top-per-category, each item kept in its first section.

    Section order: breaking (1), trending (2), category (3); within a section the
    section's own rank orders items.
    """
    b = breaking_df.select("article_id", "language", F.lit("breaking").alias("section"), F.lit(1).alias("section_order"),
                           F.row_number().over(Window.partitionBy("language").orderBy(
                               F.col("velocity").desc(), F.col("article_id"))).alias("section_rank"))
    t = trending_df.select("article_id", "language", F.lit("trending").alias("section"), F.lit(2).alias("section_order"),
                           F.col("rank").alias("section_rank"))
    c = top_cat_df.select("article_id", "language", F.lit("category").alias("section"), F.lit(3).alias("section_order"),
                          F.col("rank").alias("section_rank"))
    u = b.unionByName(t).unionByName(c)
    w = Window.partitionBy("article_id").orderBy("section_order", "section_rank")
    return u.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")
