"""Parquet scans of the driver tables.

Scans stay lazy so Catalyst pushes filters and column pruning into the parquet
reader; callers select only the columns they need.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose the driver tables as temp views (for SQL-written operators)."""
    for name in names:
        p = table_path(sf_dir, name)
        if os.path.exists(p):
            read_table(spark, sf_dir, name).createOrReplaceTempView(name)
