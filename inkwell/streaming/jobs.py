"""Structured Streaming versions of the periodic jobs (L2, L3, L4, L9); those with state of their own are in
``keyed``, those that fold batches into a stored table in ``stores``.

Inputs are file streams (new parquet files in a folder). Windowed aggregates use
event-time watermarks and append mode, so state for closed windows is dropped
and late rows beyond the delay are discarded. Sinks are parquet folders written
through checkpointed queries, so a restarted query resumes exactly where it
stopped. Every folder lives under the shared checkpoint dir named by the
session (``spark.checkpoint.dir``), never on a machine-local disk.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import ensure_checkpoint_dir


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def time_slices(df: DataFrame, order_col: str, slices: int) -> list[DataFrame]:
    """``df`` in ``slices`` ranges of ``order_col`` of equal width; rows without a value come with the first. Only the
    least and the greatest value reach the driver, and a slice keeps the partitions of ``df``."""
    num = F.col(order_col).cast("double")
    lo, hi = df.agg(F.min(num), F.max(num)).first()
    if lo is None:
        return [df]
    place = F.floor((num - F.lit(lo)) * slices / F.lit((hi - lo) or 1.0))
    place = F.when(place.isNull(), 0).otherwise(F.least(place, F.lit(slices - 1)))
    return [df.where(place == i) for i in range(slices)]


def replay(inputs: dict[str, tuple[DataFrame, str]], drain: Callable[[], None], slices: int = 4) -> None:
    """Play tables as streams: for each slice of time, write every table's rows of it to the table's folder, then
    ``drain`` once, as a scheduled job would. ``inputs`` maps a folder to a table and its order column.

    A slice is as many files as its table has partitions, and all of them are there before the job runs, so their
    order in it doesn't matter.
    """
    parts = {path: time_slices(df, order_col, slices) for path, (df, order_col) in inputs.items()}
    for i in range(max(map(len, parts.values()))):
        for path, frames in parts.items():
            if i < len(frames):
                frames[i].write.mode("append").parquet(path)
        drain()


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of a folder; a run takes all that are there as one batch."""
    return spark.readStream.schema(schema).parquet(path)


def run_available_now(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Drain everything available, then stop (trigger availableNow). A later run goes on from the checkpoint."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_velocity(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour",
                    slide: str = "5 minutes") -> DataFrame:
    """L2: interactions per item in sliding event-time windows; windows are
    emitted once the watermark (max ts - delay) passes their end."""
    return (events.withWatermark("ts", delay)
            .groupBy(F.window("ts", window, slide), "item_id")
            .agg(F.count("*").alias("interactions"))
            .select("item_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "interactions"))


def stream_breaking(articles: DataFrame, events: DataFrame, threshold: float = 0.0, minutes: int = 30,
                    delay: str = "10 minutes") -> DataFrame:
    """L4: articles whose interactions in the ``minutes`` after publication came faster than ``threshold`` a minute.

    A stream-stream join on item and time: an article is held until the watermark passes the end of its
    interval, an event until it passes the event, so state is bounded by the interval and the delay. The counts
    close as the watermark does. An event after its delay is dropped. Equals G5 asked at each article's publication
    plus ``minutes``.
    """
    a = articles.select("article_id", "language", "category_slug", "publish_time").withWatermark("publish_time", delay)
    e = events.select("item_id", "ts").withWatermark("ts", delay)
    end = F.col("publish_time") + F.expr(f"INTERVAL {int(minutes)} MINUTES")
    near = (F.col("ts") > F.col("publish_time")) & (F.col("ts") <= end)
    return (a.join(e, (F.col("item_id") == F.col("article_id")) & near)
            .groupBy("article_id", "language", "category_slug", "publish_time")
            .agg(F.count("*").alias("interactions"))
            .withColumn("velocity", F.col("interactions") / F.lit(float(minutes)))
            .where(F.col("velocity") > threshold)
            .select("article_id", "language", "category_slug", "publish_time", "interactions", "velocity"))


def stream_throughput(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Rows per hour and status in tumbling event-time windows, append mode."""
    return (log.withWatermark("ts", delay)
            .groupBy(F.window("ts", "1 hour"), "status")
            .agg(F.count("*").alias("n"))
            .select(F.col("window.start").alias("hour"), "status", "n"))


def stream_dedup(rows: DataFrame, keys: list[str], delay: str = "48 hours", ts: str = "ts") -> DataFrame:
    """L3: drop repeats of ``keys`` arriving within the watermark delay of the
    first arrival (first arrival kept)."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
