"""Tables that a stream folds its batches into.

A store is a Parquet table partitioned by ``bucket``, a hash of its keys. A batch is summed to one row a key,
joined with the buckets that it touches, and those buckets alone are written again (dynamic partition
overwrite). Each row carries the last batch that changed it: when a batch is run again after a failure, keys
that have it already stay as they are, those that have not get it. One store belongs to one checkpoint, whose
batch numbers never start anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import source_key
from inkwell.operators.recommend import HALF_LIFE_DAYS
from inkwell.operators.registry import health_counts, health_view


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The store's rows, or None before its first batch."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def fold(new: DataFrame, batch_id: int, path: str, keys: list[str], merge: Callable[[Column, Column], dict[str, Column]],
         buckets: int = 64) -> None:
    """Merge ``new`` (one row a key) into the store at ``path`` as batch ``batch_id``.

    ``merge`` takes two structs, the stored row and the new one, either of which may be null, and gives the
    columns of the result. A third of the rows under one key arrive here as one row; buckets spread the keys.
    """
    spark = new.sparkSession
    new = new.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
    try:
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        at = ["bucket", *keys]
        n = new.select(*at, F.struct("*").alias("n"))
        store = read_store(spark, path)
        if store is None:
            both = n.select("*", F.lit(None).cast(n.schema["n"].dataType).alias("o"), F.lit(None).cast("long").alias("applied"))
        else:
            old = store.where(F.col("bucket").isin(touched))
            o = old.select(*at, F.struct(*(c for c in old.columns if c != "applied")).alias("o"), "applied")
            both = o.join(n, at, "full_outer")
        # A row that this batch has already changed keeps its value.
        again = F.coalesce(F.col("applied") >= batch_id, F.lit(False))
        n = F.when(~again, F.col("n"))
        both = both.withColumn("n", n)
        columns = [c.alias(name) for name, c in merge(F.col("o"), F.col("n")).items()]
        applied = F.when(F.col("n").isNotNull(), F.lit(batch_id).cast("long")).otherwise(F.col("applied")).alias("applied")
        out = both.select(*keys, *columns, applied, "bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    finally:
        new.unpersist()


def _newer(o: Column, n: Column) -> Column:
    """The greater of two values of which either may be null."""
    return F.when(o.isNull() | (n > o), n).otherwise(o)


def _decayed(value: Column, since: Column, until: Column, half_life: float) -> Column:
    days = F.timestamp_diff("MICROSECOND", since, until) / F.lit(86400e6)
    return F.coalesce(value * F.pow(F.lit(0.5), days / F.lit(half_life)), F.lit(0.0))


def fold_profile(signals: DataFrame, batch_id: int, path: str, half_life: float = HALF_LIFE_DAYS, buckets: int = 64) -> None:
    """Fold a batch of signals (user_id, category_slug, ts, weight) into the profile store
    (user_id, category_slug, affinity, as_of). Affinity is as of the row's own time; a merge decays the older side."""
    last = signals.agg(F.max("ts").cast("string")).first()[0]  # one value
    if last is None:
        return
    as_of = F.lit(last).cast(signals.schema["ts"].dataType)
    new = signals.where(F.col("ts").isNotNull()).groupBy("user_id", "category_slug").agg(
        F.sum(_decayed(F.col("weight"), F.col("ts"), as_of, half_life)).alias("affinity")).withColumn("as_of", as_of)

    def merge(o: Column, n: Column) -> dict[str, Column]:
        at = _newer(o["as_of"], n["as_of"])
        return {"affinity": _decayed(o["affinity"], o["as_of"], at, half_life) + _decayed(n["affinity"], n["as_of"], at, half_life),
                "as_of": at}

    fold(new, batch_id, path, ["user_id", "category_slug"], merge, buckets)


def profile_at(store: DataFrame, as_of: Column, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """(user_id, category_slug, affinity) of a profile store at one time."""
    return store.select("user_id", "category_slug", _decayed(F.col("affinity"), F.col("as_of"), as_of, half_life).alias("affinity"))


def fold_articles(rows: DataFrame, batch_id: int, path: str, rejects: str, key: str = "canonical_url", order: str = "page_id",
                  valid: Column | None = None, buckets: int = 64) -> None:
    """L1: upsert a batch of parsed articles into the store at ``path``: of a key's rows the one with the greatest
    ``order`` stays, in whatever batch it comes. Rows that are not ``valid``, or have no key, go to ``rejects``, in a folder of
    the batch that a repeated batch writes anew; they don't stop the others."""
    good = F.col(key).isNotNull() if valid is None else F.coalesce(valid, F.lit(False)) & F.col(key).isNotNull()
    rows.where(~good).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
    fields = [c for c in rows.columns if c != key]
    new = rows.where(good).groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_w")).select(key, "_w.*")

    def merge(o: Column, n: Column) -> dict[str, Column]:
        takes = o.isNull() | F.coalesce(n[order] >= o[order], F.lit(False))
        return {c: F.when(takes, n[c]).otherwise(o[c]) for c in fields}

    fold(new, batch_id, path, [key], merge, buckets)


def fold_health(log: DataFrame, batch_id: int, path: str, sources: DataFrame, buckets: int = 16) -> None:
    """Fold a batch of scrape results into the health store: counts, the last event and the last error of each
    source. Results of unknown sources are dropped."""
    known = sources.select(source_key("source_name").alias("source_key")).distinct()
    rows = log.withColumn("source_key", source_key("source_name")).join(known, "source_key", "left_semi")

    def merge(o: Column, n: Column) -> dict[str, Column]:
        out = {c: F.coalesce(o[c], F.lit(0)) + F.coalesce(n[c], F.lit(0)) for c in ("success_count", "error_count")}
        return out | {c: _newer(o[c], n[c]) for c in ("last_event", "last_error_event")}

    fold(health_counts(rows), batch_id, path, ["source_key"], merge, buckets)


def health_of(store: DataFrame) -> DataFrame:
    """The health of every source in a store, as A6 gives it."""
    return health_view(store)


def stream_into(stream: DataFrame, checkpoint: str, fold_batch: Callable[[DataFrame, int], None]) -> None:
    """Drain what is available, each batch by ``fold_batch(rows, batch_id)``."""
    q = (stream.writeStream.foreachBatch(fold_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
