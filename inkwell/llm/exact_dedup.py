"""Operator 7: exact deduplication by a stateful stream.

Texts are equal when identical after replacing each run of ``[\\x20\\x09-\\x0D]`` by one space. The
rows' digests, stable identifiers and content locators (file and row in it) run through a Structured
Streaming aggregation whose state lies in RocksDB and never expires: per digest it keeps the smallest
identifier, the locator of its content and the group's size. A state changed by a micro-batch is
written with the batch's number, so a replayed batch overwrites its own output. Then, for every digest
seen more than once, the whole normalised text of each row is compared with the text at the kept
locator. Where bytes differ under one digest, those groups are formed again by the text itself.

Null text counts as empty, and empty texts equal one another. The row with the smallest doc_id stays;
a null doc_id comes after all others, and of repeated rows with one doc_id the first locator stays, so
exactly one row of each group has ``kept``. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from inkwell.llm.common import scratch, stored
from inkwell.llm.registry import query
from inkwell.sources.tables import read_table

#: Memory of all stores of an executor; what is beyond it lies on disk.
STATE_MB = 128
STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUP = "digest binary, first struct<no_id:boolean,doc_id:long,locator:struct<file:string,row:long>>, size long"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``__at`` (file, row); rows that lie in no file are first written to one."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select("*", at.alias("__at"))
    except AnalysisException:
        return stored(docs, "located").select("*", at.alias("__at"))


def stream_groups(spark: SparkSession, digests: str, files_per_batch: int | None = None) -> DataFrame:
    """Groups (digest, first, size) of the rows written at ``digests``, through keyed state on disk.

    ``files_per_batch`` bounds a micro-batch; None takes what is there as one batch.
    """
    out, marks = scratch(spark, "groups"), scratch(spark, "dedup-state")
    stream = spark.readStream.schema(spark.read.parquet(digests).schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    state = (stream.parquet(digests).groupBy("digest")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("first"),
                  F.count("*").alias("size")))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rocks = "spark.sql.streaming.stateStore.rocksdb"
    settings = {"spark.sql.streaming.stateStore.providerClass": STATE,
                f"{rocks}.boundedMemoryUsage": "true", f"{rocks}.maxMemoryUsageMB": str(STATE_MB),
                f"{rocks}.changelogCheckpointing.enabled": "true",
                # Else each of the many stores reserves disk for its logs, however small it is.
                f"{rocks}.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        run = (state.writeStream.outputMode("update").option("checkpointLocation", marks)
               .trigger(availableNow=True).foreachBatch(write).start())
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not run.lastProgress:  # no rows, no batch
        return spark.createDataFrame([], GROUP)
    changes = spark.read.schema(GROUP + ", batch long").option("basePath", out).parquet(out)
    if run.lastProgress["batchId"] == 0:
        return changes.drop("batch")
    latest = F.max_by(F.struct("first", "size"), "batch").alias("s")
    return changes.groupBy("digest").agg(latest).select("digest", "s.first", "s.size")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256,
                 files_per_batch: int | None = None) -> DataFrame:
    """(doc_id, locator, digest, keep_id, keep_locator, group_size, kept) of every row of ``docs``."""
    spark = docs.sparkSession
    rows = located(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__at").alias("locator"),
                                normalised(F.col("text")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    path = scratch(spark, "digests")
    rows.drop("text").write.parquet(path)
    groups = stream_groups(spark, path, files_per_batch)
    several = groups.where("size > 1").select("digest", F.col("first.locator").alias("keep_locator"))

    # Full bytes on hits: each row of a group against the text at the group's locator.
    hits = stored(rows.join(several, "digest"), "hits")
    keepers = hits.where("locator = keep_locator").select("digest", F.col("text").alias("keep_text"))
    unlike = stored(hits.join(keepers, "digest").where("text <> keep_text").select("digest").distinct(), "unlike")
    out = (spark.read.parquet(path).join(groups, "digest")
           .select("doc_id", "locator", "digest", F.col("first.doc_id").alias("keep_id"),
                   F.col("first.locator").alias("keep_locator"), F.col("size").alias("group_size")))
    if not unlike.isEmpty():
        by_text = hits.join(unlike, "digest", "left_semi")
        true = by_text.groupBy("digest", "text").agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "locator")).alias("first"), F.count("*").alias("size"))
        mended = by_text.join(true, ["digest", "text"]).select(
            by_text.doc_id, by_text.locator, "digest", F.col("first.doc_id").alias("keep_id"),
            F.col("first.locator").alias("keep_locator"), F.col("size").alias("group_size"))
        out = out.join(unlike, "digest", "left_anti").unionByName(mended)
    return out.withColumn("kept", F.col("locator") == F.col("keep_locator"))


def keep_first(docs: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = located(docs)
    gone = (exact_groups(docs.drop("__at"), files_per_batch=files_per_batch).where("NOT kept")
            .select(F.col("locator").alias("__at")))
    return docs.join(gone, "__at", "left_anti").drop("__at")


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query("op7_exact_dedup", SQL)
def op7_exact_dedup(spark, sf_dir):
    """Every row of documents with the row of equal text that stays."""
    return exact_groups(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
