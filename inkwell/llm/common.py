"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import ensure_checkpoint_dir


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """Only (doc_id, text, *more) with null text as empty: other columns, whatever their names, stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_key(share: int, of: int):
    """crc32(doc_id as text) mod ``of`` = ``share``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == share, F.lit(False))


def slices(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows that hold about ``size`` bytes of strings at most, one row at least."""
    wide = np.zeros(batch.num_rows, dtype=np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
            wide += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(wide), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


_held: dict = {}


def worker_memo(name, make: Callable):
    """What this worker process keeps under ``name``, made where it is missing. Spark uses a process again for other
    operators: one that asks for another name drops what it held."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def map_batches(df: DataFrame, fn: Callable[[dict], dict], schema: str, size: int = 4 << 20) -> DataFrame:
    """Apply ``fn`` (dict of Python lists to dict of lists or Arrow arrays) to each Arrow batch of ``df``, about ``size``
    bytes of strings at a time."""
    out = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, size):
                yield _batch(fn(part.to_pydict()), out)

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[dict], dict | None], schema: str,
               batch_rows: int = 20_000) -> DataFrame:
    """Apply ``fn`` to the rows of each group of ``keys`` (a dict of Python lists).

    Groups are streamed from sorted partitions, so thousands of small groups share one Arrow batch
    and only one group is held at a time; callers bound the size of a group.
    """
    out = _arrow_schema(df.sparkSession, schema)
    cols = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, done, n = {c: [] for c in cols}, None, [], 0
        for b in (part for whole in batches for part in slices(whole)):
            d = b.to_pydict()
            ks = list(zip(*(d[k] for k in keys)))
            i = 0
            while i < len(ks):
                j = i
                while j < len(ks) and ks[j] == ks[i]:
                    j += 1
                if ks[i] != key:
                    if key is not None and (r := fn(held)) is not None:
                        done.append(_batch(r, out))
                        n += done[-1].num_rows
                    held, key = {c: [] for c in cols}, ks[i]
                for c in cols:
                    held[c].extend(d[c][i:j])
                i = j
            if n >= batch_rows:
                yield from done
                done, n = [], 0
        if key is not None and (r := fn(held)) is not None:
            done.append(_batch(r, out))
        yield from done

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(cols: dict, out: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, type=f.type) for f in out], schema=out)
