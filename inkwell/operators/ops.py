"""Notifications (J1-J5) and retention/monitoring."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.time import ts_lit

DIGEST_TZ = "Asia/Kolkata"
DIGEST_HOUR = 8


# ---------------------------------------------------------------- notifications
def breaking_outbox(breaking: DataFrame, users: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """Fan a breaking article out to every user of its language, once per
    (user, article). ``breaking`` is bounded by its 30-minute window."""
    b = breaking.select("article_id", "language", "title")
    out = users.select("user_id", "language").join(b, "language").select(
        "user_id", "article_id", "title", F.lit("breaking").alias("notification_type"))
    if sent is not None:
        out = out.join(sent.select("user_id", "article_id"), ["user_id", "article_id"], "left_anti")
    return out


def daily_digest(stories: DataFrame, users: DataFrame, date: str, k: int = 3) -> DataFrame:
    """Top-k stories per language updated in the 24 h before ``date`` 08:00 IST,
    one digest row per (user, rank)."""
    end_local = f"{date} {DIGEST_HOUR:02d}:00:00"
    end_utc = F.to_utc_timestamp(F.lit(end_local).cast("timestamp"), DIGEST_TZ).cast("timestamp_ntz")
    start_utc = end_utc - F.expr("INTERVAL 24 HOURS")
    s = stories.where((F.col("last_updated_at") > start_utc) & (F.col("last_updated_at") <= end_utc))
    w = Window.partitionBy("language").orderBy(F.col("importance_score").desc(), F.col("story_id"))
    top = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "language", "story_id", "title", "rank")
    return users.select("user_id", "language").join(top, "language")


def allowed(outbox: DataFrame, prefs: DataFrame) -> DataFrame:
    """Keep a notification when the user's per-type preference allows it,
    falling back to the single notification flag, then to enabled."""
    p = prefs.select("user_id", *([F.col("notification_types")] if "notification_types" in prefs.columns
                                  else [F.lit(None).cast("map<string,boolean>").alias("notification_types")]),
                     "notification_enabled")
    j = outbox.join(p, "user_id", "left")
    ok = F.coalesce(F.element_at(F.col("notification_types"), F.col("notification_type")),
                    F.col("notification_enabled"), F.lit(True))
    return j.where(ok).drop("notification_types", "notification_enabled")


def notification_history(notes: DataFrame, n: int = 10) -> DataFrame:
    """Each user's first history page (newest first) with the unread count."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("article_id").desc())
    unread = notes.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread_count"))
    page = notes.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
    return page.join(unread, "user_id")


def latest_tokens(events: DataFrame) -> DataFrame:
    """The latest device token per user."""
    return events.groupBy("user_id").agg(F.max_by("token", F.struct("ts", "event_id")).alias("token"),
                                         F.max("ts").alias("registered_at"))


# ---------------------------------------------------------------- retention
def archive(articles: DataFrame, as_of, days: int = 14) -> DataFrame:
    """K1: flag articles older than ``days`` (published at or before as_of - days)."""
    return articles.withColumn("archived", F.col("publish_time") <= ts_lit(as_of, timedelta(days=days)))


def purge(articles: DataFrame, interactions: DataFrame, comments: DataFrame, as_of, days: int = 21):
    """K2: delete articles older than ``days`` and cascade to their interactions
    and comments (anti-joins along the FK chain). Returns the kept tables and the
    doomed article ids."""
    doomed = articles.where(F.col("publish_time") <= ts_lit(as_of, timedelta(days=days))).select("article_id")
    kept_a = articles.join(doomed, "article_id", "left_anti")
    kept_i = interactions.join(doomed.withColumnRenamed("article_id", "item_id"), "item_id", "left_anti")
    kept_c = comments.join(doomed.withColumnRenamed("article_id", "item_id"), "item_id", "left_anti")
    return kept_a, kept_i, kept_c, doomed


def purge_report(tables: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """K2/K5: per table rows before and kept (tables: name, before, after)."""
    parts = []
    for name, before, after in tables:
        b = before.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit("before").alias("state"), "n")
        a = after.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit("kept").alias("state"), "n")
        parts += [b, a]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table_name").pivot("state", ["before", "kept"]).agg(F.first("n")).withColumn(
        "purged", F.col("before") - F.col("kept"))


def preserve_aggregates(signals: DataFrame, doomed: DataFrame, items: DataFrame) -> DataFrame:
    """K3: per (user, category) weight totals of the signals on doomed articles,
    saved before the raw events go."""
    d = doomed.select(F.col("article_id").alias("item_id"))
    it = items.select(F.col("article_id").alias("item_id"), "category_slug")
    s = signals.join(d, "item_id", "left_semi").join(it, "item_id")
    return s.groupBy("user_id", "category_slug").agg(F.sum("weight").alias("weight"), F.count("*").alias("signals"))


def orphans(files: DataFrame, referenced: DataFrame, key: str = "path") -> DataFrame:
    """K4: files no row references."""
    return files.join(referenced.select(key).distinct(), key, "left_anti")


def throughput(log: DataFrame, stages=("success", "error")) -> DataFrame:
    """K6: events per hour and stage (pivot on the fixed stage list)."""
    return (log.withColumn("hour", F.date_trunc("hour", F.col("ts")))
            .groupBy("hour").pivot("status", list(stages)).agg(F.count(F.lit(1)))
            .na.fill(0, list(stages)))


def content_stats(articles: DataFrame) -> DataFrame:
    """K7: article counts by language and category with subtotals (cube)."""
    return articles.cube("language", "category_slug").agg(
        F.count("*").alias("articles"), F.grouping_id().alias("level"))


def recent(df: DataFrame, order_cols, n: int) -> DataFrame:
    """Newest n rows (TakeOrderedAndProject: per-task top-n, then merge)."""
    return df.orderBy(*order_cols).limit(n)


def scrape_dashboard(log: DataFrame) -> DataFrame:
    """K9: scrapes, errors and error rate per source and hour, with per-source
    and overall totals (rollup)."""
    d = log.withColumn("hour", F.date_trunc("hour", F.col("ts")))
    return d.rollup("source_name", "hour").agg(
        F.count("*").alias("scrapes"), F.count_if(F.col("status") == "error").alias("errors")).withColumn(
        "error_rate", F.col("errors") / F.col("scrapes"))


def ingest_dashboard(articles: DataFrame, log: DataFrame) -> DataFrame:
    """K9: per source and hour the articles, the duplicates among them, scrapes, errors and the error rate.

    An article is a duplicate if one published before it, or then with a smaller id, has the same content; null and
    empty content has none. Only the first article of each content is counted out, by aggregates, so a content that a
    third of the articles share is combined before the shuffle. Hours with articles or scrapes alone are there too.
    """
    at = ["source_name", "hour"]
    a = articles.select("source_name", F.date_trunc("hour", "publish_time").alias("hour"), "publish_time", "article_id",
                        F.when(F.length("content") > 0, F.sha2("content", 256)).alias("digest"))
    first = (a.where("digest IS NOT NULL").groupBy("digest")
             .agg(F.min_by(F.struct(*at), F.struct("publish_time", "article_id")).alias("f"))
             .select("f.*", F.lit(0).alias("articles"), F.lit(0).alias("filled"), F.lit(1).alias("firsts")))
    every = a.select(*at, F.lit(1).alias("articles"), F.col("digest").isNotNull().cast("int").alias("filled"), F.lit(0).alias("firsts"))
    found = every.unionByName(first).select("*", F.lit(0).alias("scrapes"), F.lit(0).alias("errors"))
    runs = log.select("source_name", F.date_trunc("hour", "ts").alias("hour"), F.lit(0).alias("articles"), F.lit(0).alias("filled"),
                      F.lit(0).alias("firsts"), F.lit(1).alias("scrapes"), F.coalesce(F.col("status") == "error", F.lit(False)).cast("int").alias("errors"))
    out = found.unionByName(runs).groupBy(*at).agg(
        F.sum("articles").alias("articles"), F.sum(F.col("filled") - F.col("firsts")).alias("duplicates"),
        F.sum("scrapes").alias("scrapes"), F.sum("errors").alias("errors"))
    return out.withColumn("error_rate", F.when(F.col("scrapes") > 0, F.col("errors") / F.col("scrapes")))


def integrity_report(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row per constraint with its violation count. Each check is a
    DataFrame of violating rows (built with left_anti or group-by-having)."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint_name"), "violations")
             for name, df in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fk_violations(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    c = child.where(F.col(child_key).isNotNull()).select(F.col(child_key).alias("_k"))
    return c.join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
