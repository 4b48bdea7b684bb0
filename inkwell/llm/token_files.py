"""Operator 4: token files compressed by Re-Pair grammars, shard by shard.

Documents are dealt to partitions by ranges of doc_id, sorted, and encoded in that order. A partition is
written as shards of about ``SHARD`` ids; a shard holds whole documents. In a shard, frequent pairs of
neighbouring ids are replaced by new symbols, round after round, each round with pairs that can't overlap
one another, until no pair is frequent. A shard's row in the file holds:

* ``docs``, ``null_docs``, ``lengths``: its documents' ids, which of them are null, and their numbers of ids
* ``left``, ``right``: the rules, rule i for symbol ``BASE + i``; ``expansion``: the ids that each rule stands for
* ``sequence``: the compressed sequence
* ``part``, ``shard``, ``before``, ``n_ids``: its place, the ids before it in its partition, and its ids

All numbers are little-endian; the container is Parquet, so files are committed as Spark commits them and
lie wherever Spark writes. With the expansion lengths any range of ids is decoded without the rest of the
shard. A document's global start is its partition's start (one number for each partition) and its place.

Null or empty text is a document of the end id alone. A null doc_id comes first; rows with equal doc_id
follow one another and are documents of their own. An empty table gives no rows. Only doc_id and text are
read. A very long text makes a larger shard.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import map_batches, scratch, slices, text_rows
from inkwell.llm.registry import query
from inkwell.llm.tokens import end_cut, hf_encoder
from inkwell.sources.tables import read_table

#: Ids of a shard, the first symbol of a rule, pairs replaced in a round, and the least count of one.
SHARD, BASE, PAIRS, LEAST = 1 << 20, 1 << 24, 4096, 8
_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)

FILE = ("part int, shard int, before long, n_ids long, docs binary, null_docs binary, lengths binary, "
        "left binary, right binary, expansion binary, sequence binary")


@dataclass
class Grammar:
    """A compressed sequence of ids with its rules."""

    left: np.ndarray
    right: np.ndarray
    expansion: np.ndarray
    sequence: np.ndarray

    def widths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), dtype=np.int64)
        rule = symbols >= BASE
        out[rule] = self.expansion[symbols[rule] - BASE]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of ``symbols``: each rule among them is expanded once and its ids are copied to its places."""
        rule = symbols >= BASE
        used = np.zeros(len(self.left), dtype=bool)
        used[symbols[rule] - BASE] = True
        rules = np.flatnonzero(used)
        table = self._unfold(rules + BASE)
        start = np.zeros(len(self.left), dtype=np.int64)
        start[rules] = np.cumsum(self.expansion[rules]) - self.expansion[rules]
        widths = self.widths(symbols)
        at = np.cumsum(widths) - widths
        out = np.empty(int(widths.sum()), dtype=np.int64)
        out[at[~rule]] = symbols[~rule]
        begin, wide = at[rule], widths[rule]
        step = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
        out[np.repeat(begin, wide) + step] = table[np.repeat(start[symbols[rule] - BASE], wide) + step]
        return out

    def _unfold(self, symbols: np.ndarray) -> np.ndarray:
        while (rule := symbols >= BASE).any():
            at = np.cumsum(1 + rule) - 1 - rule
            out = np.empty(len(symbols) + int(rule.sum()), dtype=np.int64)
            out[at] = np.where(rule, self.left[np.where(rule, symbols - BASE, 0)], symbols) if len(self.left) else symbols
            out[at[rule] + 1] = self.right[symbols[rule] - BASE]
            symbols = out
        return symbols

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop``; only the symbols that cover them are expanded."""
        if start == 0 and stop is None:
            return self.expand(self.sequence)
        ends = np.cumsum(self.widths(self.sequence))
        total = int(ends[-1]) if len(ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, dtype=np.int64)
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(self.sequence[a:b + 1])[skip:skip + stop - start]


def frequent_pairs(key: np.ndarray, place: np.ndarray) -> list[int]:
    """Up to PAIRS of the most frequent keys, the most frequent first. All keys whose hash place has LEAST or
    more are counted exactly."""
    count = np.bincount(place, minlength=1 << _BITS)
    keys, times = np.unique(key[count[place] >= LEAST], return_counts=True)
    good = times >= LEAST
    keys, times = keys[good], times[good]
    return keys[np.lexsort((keys, -times))[:PAIRS]].tolist()


def re_pair(ids: np.ndarray) -> Grammar:
    """Replace frequent pairs of ``ids`` (below BASE) by rules."""
    seq, left, right, width = ids.astype(np.int64), [], [], []
    while len(seq) >= 2 * LEAST:
        key = seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:].astype(np.uint64)
        place = (key * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)
        chosen, firsts, seconds = [], set(), set()
        # Of two pairs that could overlap, the more frequent one is taken.
        for k in frequent_pairs(key, place):
            a, b = k >> 32, k & 0xFFFFFFFF
            if a != b and a not in seconds and b not in firsts:
                firsts.add(a)
                seconds.add(b)
                chosen.append(k)
            elif a == b and a not in firsts and a not in seconds:
                firsts.add(a)
                seconds.add(a)
                chosen.append(k)
        if not chosen:
            break
        keys = np.sort(np.array(chosen, dtype=np.uint64))
        marked = np.zeros(1 << _BITS, dtype=bool)
        marked[(keys * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        at = np.flatnonzero(marked[place])
        rule = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
        real = keys[rule] == key[at]
        at, rule = at[real], rule[real]
        # In a run of one id its pairs overlap: every second one counts, from the run's start.
        new = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, dtype=bool)
        odd = (np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))) % 2 == 1
        at, rule = at[~odd], rule[~odd]
        base = BASE + len(left)
        a, b = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        sizes = np.array(width, dtype=np.int64)
        for x in (a, b):
            x_rule = x >= BASE
            w = np.ones(len(x), dtype=np.int64)
            w[x_rule] = sizes[x[x_rule] - BASE]
            total = w if x is a else total + w
        left += a.tolist()
        right += b.tolist()
        width += total.tolist()
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq[at] = base + rule
        seq = seq[keep]
    return Grammar(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(width, dtype=np.int64), seq)


def write_tokens(docs: DataFrame, path: str, encoder: Callable, end_id: int, shard: int = SHARD) -> None:
    """Write every document's ids to ``path`` in ascending doc_id order."""
    out = _schema()

    def row(part: int, number: int, before: int, ids: list, encoded: list[bytes]) -> pa.RecordBatch:
        g = re_pair(np.frombuffer(b"".join(encoded), dtype="<u4"))
        lengths = np.array([len(e) // 4 for e in encoded], dtype="<i8")
        values = [part, number, before, int(lengths.sum()),
                  np.array([i or 0 for i in ids], dtype="<i8").tobytes(), bytes(i is None for i in ids), lengths.tobytes(),
                  *(x.astype("<u4").tobytes() for x in (g.left, g.right, g.expansion, g.sequence))]
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, out)], schema=out)

    def shards(batches):
        from pyspark import TaskContext
        part, number, before, ids, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        for b in (part for whole in batches for part in slices(whole)):
            d = b.to_pydict()
            for i, e in zip(d["doc_id"], end_cut(encoder()(d["text"]), end_id)):
                ids.append(i)
                held.append(e)
                size += len(e) // 4
                if size >= shard:
                    yield row(part, number, before, ids, held)
                    number, before, ids, held, size = number + 1, before + size, [], [], 0
        if held:
            yield row(part, number, before, ids, held)

    key = ["doc_id", "text_key"]
    rows = text_rows(docs).withColumn("text_key", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.select("doc_id", "text").mapInArrow(shards, FILE).write.parquet(path)


def _schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in FILE.split(", "))])


def grammar_of(d: dict, i: int) -> Grammar:
    return Grammar(*(np.frombuffer(d[c][i], dtype="<u4").astype(np.int64) for c in ("left", "right", "expansion", "sequence")))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document of the files at ``path``."""
    files = spark.read.schema(FILE).parquet(path)
    # One row for each partition reaches the driver.
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, at = [], 0
    for r in sizes:
        starts.append((r["part"], at))
        at += r["n"]
    rows = files.join(spark.createDataFrame(starts, "part int, from long"), "part")

    def decode(d: dict) -> dict:
        out = {"doc_id": [], "start": [], "ids": []}
        for i in range(len(d["part"])):
            raw = grammar_of(d, i).ids().astype("<u4").tobytes()
            ends = np.cumsum(np.frombuffer(d["lengths"][i], dtype="<i8")).tolist()
            begins = [0, *ends[:-1]]
            none = d["null_docs"][i]
            out["doc_id"] += [None if none[k] else x for k, x in enumerate(np.frombuffer(d["docs"][i], dtype="<i8").tolist())]
            out["start"] += [d["from"][i] + d["before"][i] + a for a in begins]
            out["ids"] += [raw[4 * a:4 * b] for a, b in zip(begins, ends)]
        return out

    return map_batches(rows, decode, "doc_id long, start long, ids binary")


def read_range(shard: DataFrame, start: int, stop: int) -> list[int]:
    """Ids ``start`` to ``stop`` of one shard (a frame of its one row)."""
    d = shard.limit(1).toArrow().to_pydict()
    return grammar_of(d, 0).ids(start, stop).tolist()


@query("op4_token_files")
def op4_token_files(spark, sf_dir):
    """Every document's place and ids' checksum, read back from the files."""
    path = scratch(spark, "token-files")
    write_tokens(read_table(spark, sf_dir, "documents"), path, hf_encoder("word_bpe_49k.json", keeps_space=False), 1)

    return read_tokens(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                                           F.crc32("ids").alias("ids_crc32"))
