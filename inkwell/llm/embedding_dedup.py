"""Operator 6: near-duplicate vectors by sorted projection passes.

Equal vectors are one class. In each pass every class, less the mean of the unit vectors of its length,
has a key of ``BITS`` random hyperplane signs; the classes are put in the lexicographic order of the keys,
and each is compared with the ``WINDOW`` next ones. There are as many passes (``PASSES`` at least) as a
pair at just the cut needs to be in one window with the chance ``RECALL``, by the number of classes and
the length of their mean. Pairs with cosine >= ``CUT`` (in double precision) are verified links; a task
returns those that join something in its local union-find, and the links of all passes are united into
components. The order is dealt to tasks by exact ranks, ``GROUP`` classes each and the window's overlap,
so equal or hot keys can't fill one task.

A window is bounded and a group of similar vectors may be larger. So the links of each class are counted
inside its component by an exact check: the component is split into blocks of about ``BLOCK_ROWS``
classes, and a task compares two blocks and returns a count for each class. No list of pairs is ever
written; the work of this check grows with the square of a component's size. What stays unfound is a
link between two components that no pass has joined; the README states the recall measured.

Vectors that are null, of no length or zero, or hold null or non-finite components link with nothing.
Vectors of different lengths don't link. Every row counts as a vector of its own, also one with a
repeated vec_id; ``component_id`` is the smallest vec_id of the component, ignoring nulls. An empty table
gives no rows. Only vec_id and embedding are read, labels never.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from inkwell.llm.common import map_batches, map_groups, stored
from inkwell.llm.registry import query
from inkwell.operators.components import connected_components
from inkwell.sources.tables import read_table

CUT, PASSES, WINDOW, BITS, GROUP, BLOCK_ROWS = 0.9, 16, 256, 64, 4096, 1024
#: The chance of a pair at the cut, as far from the mean as the average, to be in one window of some pass. Pairs
#: nearer to the mean have less; the aim is 0.99 of all.
RECALL = 0.999
#: Rows whose products are held at a time inside a task.
AT_A_TIME = 256


@cache
def planes(dim: int, passes: int) -> np.ndarray:
    """The hyperplanes of all passes, the same on every worker."""
    return np.random.default_rng([dim, passes, 20240131]).standard_normal((dim, passes * BITS))


def signs(x: np.ndarray, passes: int) -> np.ndarray:
    """Keys (rows, passes) as signed integers whose order is the lexicographic order of the signs."""
    bits = np.concatenate([np.packbits(x[s:s + AT_A_TIME] @ planes(x.shape[1], passes) > 0, axis=1)
                           for s in range(0, len(x), AT_A_TIME)])
    return (bits.reshape(len(x), passes, 8).view(">u8")[:, :, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def usable(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(row's vec_id, digest, vector bytes or null) and the numpy type of the bytes."""
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"

    def apply(d: dict) -> dict:
        raw = []
        for e in d["embedding"]:
            x = np.array(e, dtype=kind) if e and None not in e else np.zeros(1)
            wide = x.astype(np.float64)
            raw.append(x.tobytes() if np.isfinite(wide).all() and wide.any() else None)
        return {"vec_id": d["vec_id"], "vector": raw,
                "digest": [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]}

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    return map_batches(rows, apply, "vec_id long, vector binary, digest binary"), kind


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def passes_for(n: int, common: float, cut: float = CUT, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes that find a pair at ``cut`` with the chance ``recall`` among ``n`` classes.

    ``common`` is the squared length of the mean of the unit vectors. A pair is in one window where as many
    leading signs agree as cut ``n`` classes to a window's; without the mean its cosine is less.
    """
    if n <= window:
        return 1
    apart = math.acos(max(-1.0, (cut - common) / max(1 - common, 1e-9))) / math.pi
    once = max((n / window) ** math.log2(max(1 - apart, 1e-9)), window / n)
    return math.ceil(math.log(1 - recall) / math.log(max(1 - once, 1e-9)))


def centres(classes: DataFrame, kind: str) -> dict[int, tuple[int, np.ndarray]]:
    """(classes, mean of their unit vectors) of each length of vectors in bytes."""

    def sums(d: dict) -> dict:
        dims = np.array([len(v) for v in d["vector"]])
        kinds = np.unique(dims)
        own = [np.flatnonzero(dims == n) for n in kinds]
        return {"dim": kinds, "n": [len(o) for o in own],
                "total": [unit([d["vector"][i] for i in o], kind).sum(axis=0).tolist() for o in own]}

    schema = "dim int, n long, total array<double>"
    rows = map_groups(map_batches(classes.select("vector"), sums, schema), ["dim"], lambda d: {
        "dim": d["dim"][:1], "n": [sum(d["n"])], "total": [np.sum(d["total"], axis=0).tolist()]}, schema)
    return {r["dim"]: (r["n"], np.array(r["total"]) / r["n"]) for r in rows.collect()}


def ranked(classes: DataFrame, kind: str, passes: int, middle: dict[int, np.ndarray]) -> DataFrame:
    """(digest, dim, pass, rank): each class's place in the order of each pass."""

    def keys(d: dict) -> dict:
        out: list = [None] * len(d["vector"])
        dims = np.array([len(v) for v in d["vector"]])
        for n in np.unique(dims):
            own = np.flatnonzero(dims == n)
            for i, k in zip(own, signs(unit([d["vector"][j] for j in own], kind) - middle[int(n)], passes)):
                out[i] = k
        return {"digest": d["digest"], "dim": dims, "keys": out}

    rows = map_batches(classes.select("digest", "vector"), keys, "digest binary, dim int, keys array<long>")
    rows = rows.select("digest", "dim", F.posexplode("keys").alias("pass", "key"))
    order = ["dim", "pass", "key", "digest"]
    parts = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, at, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            n, places = b.num_rows, []
            for o in zip(b.column("dim").to_pylist(), b.column("pass").to_pylist()):
                at, last = (at + 1, last) if o == last else (0, o)
                places.append(at)
            yield pa.RecordBatch.from_arrays([*b.select(["digest", "dim", "pass"]).columns, pa.array([part] * n, pa.int32()),
                                              pa.array(places, pa.int64())], names=["digest", "dim", "pass", "part", "place"])

    placed = stored(dealt.select("digest", "dim", "pass", "key").mapInArrow(
        count, "digest binary, dim int, pass int, part int, place long"), "places")
    # One row for each partition and pass: rows before it in the same order.
    sizes = placed.groupBy("dim", "pass", "part").agg(F.count("*").alias("n")).orderBy("part").collect()
    before, seen = [], {}
    for r in sizes:
        before.append((r["dim"], r["pass"], r["part"], seen.get((r["dim"], r["pass"]), 0)))
        seen[r["dim"], r["pass"]] = before[-1][3] + r["n"]
    offsets = classes.sparkSession.createDataFrame(before, "dim int, pass int, part int, before long")
    return placed.join(offsets, ["dim", "pass", "part"]).select(
        "digest", "dim", "pass", (F.col("place") + F.col("before")).alias("rank"))


def _forest(n: int):
    """``join(i, j)``: whether i and j were apart until now."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def join(i: int, j: int) -> bool:
        u, v = find(i), find(j)
        root[u] = v
        return u != v

    return join


def window_links(d: dict, kind: str, cut: float, window: int, group: int) -> dict | None:
    """Links that join something among one group of a pass: its core, and the window behind each row."""
    order = np.argsort(np.array(d["rank"]), kind="stable")
    x, core = unit(d["vector"], kind)[order], int((np.array(d["rank"]) // group == d["group"][0]).sum())
    join, src, dst = _forest(len(order)), [], []
    for s in range(0, core, AT_A_TIME):
        e = min(core, s + AT_A_TIME)
        i, j = np.nonzero(x[s:e] @ x[s:e + window].T >= cut)
        near = (j > i) & (j - i <= window)
        for a, b in zip(order[i[near] + s].tolist(), order[j[near] + s].tolist()):
            if join(a, b):
                src.append(d["digest"][a])
                dst.append(d["digest"][b])
    return {"src": src, "dst": dst} if src else None


def count_links(d: dict, kind: str, cut: float) -> dict | None:
    """(digest, links) inside one block, or between two blocks, of a component."""
    x, size = unit(d["vector"], kind), np.array(d["size"], dtype=np.int64)
    first = np.array(d["own"]) == d["a"][0]
    left = np.flatnonzero(first)
    within = d["a"][0] == d["b"][0]
    right = left if within else np.flatnonzero(~first)
    many = np.zeros(len(x), dtype=np.int64)
    for s in range(0, len(left), AT_A_TIME):
        rows = left[s:s + AT_A_TIME]
        near = x[rows] @ x[right].T >= cut
        if within:
            near[np.arange(len(rows)), s + np.arange(len(rows))] = False
        else:
            many[right] += size[rows] @ near
        many[rows] += near @ size[right]
    linked = np.flatnonzero(many).tolist()
    return {"digest": [d["digest"][i] for i in linked], "links": many[linked]} if linked else None


def counted(classes: DataFrame, named: DataFrame, kind: str, cut: float, block: int) -> DataFrame:
    """(digest, links): vectors of other classes that each class of a component links with."""
    parts = named.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
    members = named.join(parts, "component").withColumn("own", own).join(
        classes.select("digest", "vector", "size"), "digest")
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "component", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "digest", "vector", "size")
    found = map_groups(pairs, ["component", "a", "b"], lambda d: count_links(d, kind, cut), "digest binary, links long")
    return found.groupBy("digest").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, cut: float = CUT, passes: int | None = None, window: int = WINDOW,
                 group: int = GROUP, block: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    rows, kind = usable(vectors)
    rows = stored(rows, "vectors")
    classes = stored(rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.first("vector").alias("vector"), F.count("*").alias("size"), F.min("vec_id").alias("first")), "vector-classes")
    found = centres(classes, kind)
    passes = passes or max([PASSES, *(passes_for(n, float(m @ m), cut, window) for n, m in found.values())])
    ranks = ranked(classes, kind, passes, {dim: m for dim, (_, m) in found.items()})
    own = F.floor(F.col("rank") / group).cast("long")
    # The first rows of a group are the window of the last rows of the one before.
    groups = F.when((F.col("rank") % group < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = classes.select("digest", "vector").join(ranks, "digest").withColumn("group", F.explode(groups))
    links = stored(map_groups(dealt, ["dim", "pass", "group"], lambda d: window_links(d, kind, cut, window, group),
                              "src binary, dst binary"), "vector-links")
    named = stored(connected_components(links).withColumnRenamed("vertex", "digest"), "vector-components")
    many = counted(classes, named, kind, cut, block)
    by_class = (classes.select("digest", "size", "first")
                .join(named, "digest", "left").join(many, "digest", "left")
                .withColumn("component", F.coalesce("component", "digest")))
    ids = by_class.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = by_class.join(ids, "component").select(
        "digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    good = rows.where("digest IS NOT NULL").join(by_class, "digest").select("vec_id", "n_links", "component_id")
    bad = rows.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op6_embedding_dedup")
def op6_embedding_dedup(spark, sf_dir):
    """Every vector with its links and its component."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
