"""User interaction operators.

Input schema (``interaction_events``): event_id, ts, user_id, item_id,
interaction_type (read|like|bookmark|share|comment), time_spent_seconds,
action (like|unlike|bookmark|unbookmark|read|share|comment).

All aggregates are algebraic (count/sum/max/max_by), so Spark computes them as a
partial aggregate on the map side before the shuffle: a hot item or user ships
one partial row per map task, not its raw events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.time import in_window, ts_lit

# Signal weights per interaction (spec). A read longer than
# 5 seconds adds the "time spent" weight on top of the read weight.
WEIGHTS = {"read": 1.0, "time_spent": 2.0, "like": 3.0, "bookmark": 4.0, "comment": 5.0, "share": 7.0}
TIME_SPENT_MIN_SECONDS = 5.0

TOGGLE_ON = {"like": "like", "bookmark": "bookmark"}
TOGGLE_OFF = {"like": "unlike", "bookmark": "unbookmark"}


def _toggle_kind() -> F.Column:
    a = F.col("action")
    return (F.when(a.isin("like", "unlike"), F.lit("like"))
            .when(a.isin("bookmark", "unbookmark"), F.lit("bookmark")))


def toggle_state(events: DataFrame) -> DataFrame:
    """latest like/unlike and bookmark/unbookmark per (user, item, kind).

    At most one active state per user, item and kind; ties on ts break by event id.
    """
    ev = (events.select("user_id", "item_id", "ts", "event_id", "action")
          .withColumn("kind", _toggle_kind())
          .where(F.col("kind").isNotNull()))
    last = F.max_by(F.col("action"), F.struct("ts", "event_id"))
    return (ev.groupBy("user_id", "item_id", "kind")
            .agg(last.alias("last_action"), F.max("ts").alias("last_ts"))
            .select("user_id", "item_id", "kind",
                    F.col("last_action").isin(*TOGGLE_ON.values()).alias("active"), "last_ts"))


def interaction_counts(events: DataFrame) -> DataFrame:
    """per item counts of reads, comments, shares (events) and of active likes
    and bookmarks (toggle state)."""
    base = (events.groupBy("item_id").agg(
        F.count_if(F.col("interaction_type") == "read").alias("reads"),
        F.count_if(F.col("interaction_type") == "comment").alias("comments"),
        F.count_if(F.col("interaction_type") == "share").alias("shares")))
    toggles = (toggle_state(events).where("active").groupBy("item_id").agg(
        F.count_if(F.col("kind") == "like").alias("likes"),
        F.count_if(F.col("kind") == "bookmark").alias("bookmarks")))
    return (base.join(toggles, "item_id", "full_outer")
            .select("item_id",
                    *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                      for c in ("reads", "likes", "comments", "shares", "bookmarks")]))


def limit_comments(events: DataFrame, n: int = 100) -> DataFrame:
    """keep the first ``n`` comments per user per calendar day (by ts, event id).

    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before the
    shuffle, so a user with a flood of comments ships at most n rows per map task.
    """
    c = events.where(F.col("interaction_type") == "comment")
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return (c.withColumn("day_rank", F.row_number().over(w))
            .where(F.col("day_rank") <= n)
            .withColumn("day", F.to_date("ts")))


def read_stats(events: DataFrame) -> DataFrame:
    """opens, total and average time spent per (user, item)."""
    r = events.where(F.col("interaction_type") == "read")
    return r.groupBy("user_id", "item_id").agg(
        F.count("*").alias("opens"),
        F.sum("time_spent_seconds").alias("total_time"),
        F.avg("time_spent_seconds").alias("avg_time"))


def reading_history(events: DataFrame, as_of, days: int = 7) -> DataFrame:
    """distinct items read in ``(as_of - days, as_of]``, newest last view first."""
    r = events.where((F.col("interaction_type") == "read")
                     & in_window(F.col("ts"), as_of, days * 86400))
    last = r.groupBy("user_id", "item_id").agg(F.max("ts").alias("last_viewed"))
    w = Window.partitionBy("user_id").orderBy(F.col("last_viewed").desc(), F.col("item_id"))
    return last.withColumn("position", F.row_number().over(w))


def user_stats(events: DataFrame, as_of) -> DataFrame:
    """articles read, likes given, current and longest daily activity streak.

    Gaps-and-islands: distinct active days per user, island key = day - row_number.
    The current streak is the island that ends on as_of's day or the day before.
    """
    ev = events.where(F.col("ts") <= ts_lit(as_of))
    counts = ev.groupBy("user_id").agg(
        F.count_distinct(F.when(F.col("interaction_type") == "read", F.col("item_id"))).alias("articles_read"),
        F.count_if(F.col("action") == "like").alias("likes"))
    days = ev.select("user_id", F.to_date("ts").alias("day")).distinct()
    w = Window.partitionBy("user_id").orderBy("day")
    islands = (days.withColumn("grp", F.date_sub(F.col("day"), F.row_number().over(w)))
               .groupBy("user_id", "grp")
               .agg(F.count("*").alias("len"), F.max("day").alias("last_day")))
    as_of_day = F.to_date(ts_lit(as_of))
    streaks = islands.groupBy("user_id").agg(
        F.max("len").alias("longest_streak"),
        F.coalesce(F.max(F.when(F.col("last_day") >= F.date_sub(as_of_day, 1), F.col("len"))),
                   F.lit(0)).alias("current_streak"))
    return counts.join(streaks, "user_id", "left").select(
        "user_id", F.col("articles_read").cast("bigint").alias("articles_read"),
        F.col("likes").cast("bigint").alias("likes"),
        F.coalesce("current_streak", F.lit(0)).cast("bigint").alias("current_streak"),
        F.coalesce("longest_streak", F.lit(0)).cast("bigint").alias("longest_streak"))


def event_weight() -> F.Column:
    """Weight of one event; unlike/unbookmark score 0."""
    t, a = F.col("interaction_type"), F.col("action")
    read_w = F.lit(WEIGHTS["read"]) + F.when(
        F.coalesce(F.col("time_spent_seconds"), F.lit(0.0)) > TIME_SPENT_MIN_SECONDS,
        F.lit(WEIGHTS["time_spent"])).otherwise(F.lit(0.0))
    return (F.when(t == "read", read_w)
            .when(a == "like", F.lit(WEIGHTS["like"]))
            .when(a == "bookmark", F.lit(WEIGHTS["bookmark"]))
            .when(t == "comment", F.lit(WEIGHTS["comment"]))
            .when(t == "share", F.lit(WEIGHTS["share"]))
            .otherwise(F.lit(0.0)))


def weighted_signals(events: DataFrame) -> DataFrame:
    """one weighted signal per event."""
    return events.select("event_id", "ts", "user_id", "item_id", "interaction_type",
                         event_weight().alias("weight"))


def engagement_matrix(signals: DataFrame) -> DataFrame:
    """H1: sum of signal weights per (user, item)."""
    return signals.groupBy("user_id", "item_id").agg(
        F.sum("weight").alias("engagement"), F.count("*").alias("signals"))
