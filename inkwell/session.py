"""Spark session construction and lineage-cutting helpers.

Cluster settings (shuffle partitions, checkpoint dir, broadcast threshold) are
read from the session when already set; defaults here only fill gaps, so the
same code runs under ``local[8]`` tests and on a cluster launched by
``spark-submit`` with its own configuration.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "inkwell") -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    # What the launcher has set (spark-submit passes it on as system properties) stays.
    given = SparkConf()
    wanted = {**_DEFAULTS, "spark.app.name": app_name,
              "spark.master": master or os.environ.get("INKWELL_MASTER", "local[8]"),
              "spark.driver.memory": os.environ.get("INKWELL_DRIVER_MEMORY", "16g"),
              "spark.sql.shuffle.partitions": str(shuffle_partitions or os.environ.get("INKWELL_SHUFFLE_PARTITIONS", "8"))}
    spark = SparkSession.builder.config(map={k: v for k, v in wanted.items() if not given.contains(k)}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory named by ``spark.checkpoint.dir``.

    On a cluster the launcher sets it to a shared (HDFS/S3/ABFS) folder and we use it
    as is; without one a cluster run fails. Only a local master gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        # Unset only in local tests, where one machine holds everything.
        configured = tempfile.mkdtemp(prefix="inkwell-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a side that may be sent to every executor.
BROADCAST_ROWS = 200_000


def sized_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``rows`` rows; as it is otherwise, for a join that AQE splits."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
