"""Partitioned tables of which a write touches only the partitions that change.

An upsert finds the partitions of earlier versions of its keys in a small table beside the main one
(``<path>-keys``: key and partition, in hash buckets of which only the batch's are read and written), so a row whose
date changes leaves its old partition. A partition that becomes empty must still be written, or its old rows would
stay: every partition that an upsert writes holds one row without a key, which ``read_keyed`` leaves out.
Running the same batch again changes nothing: the main table is written before the keys.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell.functions.time import ts_lit
from inkwell.session import cut_lineage

BUCKETS = 64


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_keyed(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """The rows of a table that ``upsert`` writes; none before its first batch."""
    return _read(spark, path, schema).where(F.col(key).isNotNull())


def overwrite_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Write ``rows``; partitions of ``by`` that they have no row of stay as they are. AQE cuts a large partition
    over several tasks and gathers small ones."""
    (rows.hint("rebalance", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(by).parquet(path))


def _one_of(by: str, values: list) -> Column:
    known = [v for v in values if v is not None]
    found = F.col(by).isin(known) if known else F.lit(False)
    return found | F.col(by).isNull() if len(known) < len(values) else found


def upsert(new: DataFrame, path: str, key: str, order: list[str], by: str, buckets: int = BUCKETS) -> list:
    """Merge ``new`` into the table at ``path``: of a key's rows, stored or new, the one with the greatest
    ``order`` stays. Rows without a key are left out. Returns the partitions written: values of ``by``, of which the
    driver sees those of one batch. The columns of a table never change.
    """
    spark, keys = new.sparkSession, f"{path}-keys"
    fields = [c for c in new.columns if c != key]

    def newest(rows: DataFrame) -> DataFrame:  # combined before the shuffle, so a hot key is one row a task
        best = F.max_by(F.struct(*fields), F.struct(*order)).alias("_w")
        return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "_w.*").select(*new.columns)

    new = cut_lineage(newest(new))
    places = new.select(key, by).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    hit = [r["bucket"] for r in places.select("bucket").distinct().collect()]
    if not hit:
        return []
    known = _read(spark, keys, places.schema).where(F.col("bucket").isin(hit))
    before = known.join(places.select(key), key, "left_semi")
    touched = [r[by] for r in places.select(by).unionByName(before.select(by)).distinct().collect()]
    merged = newest(_read(spark, path, new.schema).where(_one_of(by, touched)).unionByName(new))
    kinds = {f.name: f.dataType for f in new.schema.fields}
    marks = spark.createDataFrame([(v,) for v in touched], StructType([new.schema[by]])).select(
        *[F.col(c) if c == by else F.lit(None).cast(kinds[c]).alias(c) for c in new.columns])
    overwrite_partitions(merged.unionByName(marks), path, by)
    # The partition of a key is where its winning row now lies, which may be the old one.
    now = read_keyed(spark, path, new.schema, key).where(_one_of(by, touched)).join(places.select(key, "bucket"), key)
    others = known.join(places.select(key), key, "left_anti")
    overwrite_partitions(others.unionByName(now.select(key, by, "bucket")), keys, "bucket")
    return touched


def archive_partitions(spark: SparkSession, path: str, schema: StructType, as_of, days: int = 14, by: str = "publish_date",
                       time: str = "publish_time") -> list:
    """K1: set ``archived`` on rows published ``days`` before ``as_of`` or earlier. Only partitions up to that day are
    read, and only those with a row still to be archived are written."""
    cut = ts_lit(as_of, timedelta(days=days))
    due = (F.col(time) <= cut) & ~F.coalesce("archived", F.lit(False))
    rows = _read(spark, path, schema).where((F.col(by) <= F.to_date(cut)) | F.col(by).isNull())
    touched = [r[by] for r in rows.where(due).select(by).distinct().collect()]
    if touched:
        flag = F.when(F.col(time) <= cut, F.lit(True)).otherwise(F.col("archived"))
        overwrite_partitions(_read(spark, path, schema).where(_one_of(by, touched)).withColumn("archived", flag), path, by)
    return touched
