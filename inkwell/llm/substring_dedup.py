"""Operator 2: removal of repeated passages by sliding spans of units.

A text is cut into units of ``SHORTEST`` to ``LONGEST`` words at places that the words around them choose:
word by word in the order of a hash of the word and its next one, those that begin a sentence (after
``.!?`` and white space, after full-width marks, at line ends) before all others, a word begins a unit
unless one within ``SHORTEST`` words does already. So a passage has the same units wherever it begins,
but for some words at its two ends, whether its sentences are short or long; only the first and the last
unit of a text may be shorter. A character of a script written without spaces (Chinese, Japanese, Thai,
Lao, Khmer, Burmese) counts as a word.

Every run of ``RUN`` consecutive units with at least ``LEAST_WORDS`` words (all have, but one that holds the
short first or last unit of a text) is hashed (white space and case apart) and met globally. Of runs with one hash the first in order of doc_id
and place stays; the units that any other one covers are removed where at least ``LEAST_SPAN`` words of
them lie in a row: passages go, common phrases stay. What a repeated passage has before its first and after its
last common unit stays, too.

Hashes have 128 bits. Only the first of the equal runs of a batch of documents meets those of other
batches, so a very frequent run has one row a batch in its task; the others are known to go.

Null text counts as empty; empty and short texts have no run and stay as they are. A null doc_id comes
after all others. Rows with equal doc_id and text are one document: they get the same result and don't
remove each other. A text may become empty; its row stays. An empty table gives no rows. Only doc_id
and text are read, and whole texts are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import map_batches, text_rows, worker_memo
from inkwell.llm.registry import query
from inkwell.sources.tables import read_table

RUN, SHORTEST, LEAST_WORDS = 3, 4, 10
#: Words that a stretch of covered units has at least if it goes.
LEAST_SPAN = 32
LONGEST = 2 * SHORTEST - 1

_END = re.compile(r"[.!?…]+[\"')\]]*\s+|[。！？]+\s*|\n\s*")
_ALONE = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff"
          "\u3400-\u4dbf\u4e00-\u9fff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
_MARK = "".join(c for c in map(chr, [*range(0x0e00, 0x1100), *range(0x1780, 0x1800), 0x3099, 0x309a, 0xff9e, 0xff9f])
                if unicodedata.category(c)[0] == "M" or c in "\uff9e\uff9f")
_WORD = re.compile(rf"[{_ALONE}][{_MARK}]*|[^\s{_ALONE}]+")
_WORD_ALONE = re.compile(f"[{_ALONE}]")
#: White space as str.split() has it; none lies beyond the ideographic space.
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Hashes(dict):
    """Hashes of the words met by this worker, a bounded number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.lower().encode())
        return h


def cuts(words: list[str], begins: np.ndarray) -> list[int]:
    """The places in ``words`` where units begin; ``begins`` marks the words that begin a sentence."""
    n = len(words)
    h = np.fromiter(map(worker_memo(_Hashes, _Hashes).__getitem__, words), dtype=np.uint64, count=n)
    key = h * _MIX[0]
    key[:-1] ^= h[1:] * _MIX[1] >> np.uint64(7)
    key = key * _MIX[1] >> np.uint64(1) | (~begins).astype(np.uint64) << np.uint64(63)
    near, around = bytearray(n + 2 * SHORTEST), b"\1" * (2 * SHORTEST - 1)
    out = []
    for i in np.argsort(key, kind="stable").tolist():
        if not near[i + SHORTEST]:
            near[i + 1:i + 2 * SHORTEST] = around
            out.append(i)
    out.sort()
    return out if out[0] == 0 else [0, *out]


def split(text: str) -> tuple[list[str], np.ndarray]:
    """(words, where each begins in ``text``)."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if len(code) and code.max() >= 0x0e00 and _WORD_ALONE.search(text):
        found = list(_WORD.finditer(text))
        return [m[0] for m in found], np.array([m.start() for m in found], dtype=np.int64)
    solid = np.ones(len(code) + 1, dtype=bool)
    solid[0] = False
    solid[1:] = ~_SPACE[np.minimum(code, len(_SPACE) - 1)]
    return text.split(), np.flatnonzero(solid[1:] & ~solid[:-1])


def units(text: str) -> tuple[list[int], list[list[str]]]:
    """(ends, words) of the units of ``text``; a unit begins where the one before it ends."""
    words, at = split(text)
    if not words:
        return [], []
    begins = np.zeros(len(words) + 1, dtype=bool)
    begins[np.searchsorted(at, [0, *(m.end() for m in _END.finditer(text))])] = True
    first = cuts(words, begins[:-1])
    return [*at[first[1:]].tolist(), len(text)], [words[i:j] for i, j in zip(first, [*first[1:], len(words)])]


def runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, h1, h2) of the runs of ``text`` that have enough words."""
    _, words = units(text)
    if len(words) < RUN:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    raw = b"".join(xxhash.xxh3_128_digest(" ".join(w).lower().encode()) for w in words)
    h = np.frombuffer(raw, dtype=">u8").reshape(-1, 2).astype(np.uint64)
    n = len(words) - RUN + 1
    count = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    many, mixed = np.zeros(n, dtype=np.int64), [np.zeros(n, dtype=np.uint64) for _ in _MIX]
    for i in range(RUN):
        many += count[i:i + n]
        for k, m in enumerate(_MIX):
            mixed[k] = mixed[k] * m + h[i:i + n, k]
    at = np.flatnonzero(many >= LEAST_WORDS)
    return at, mixed[0][at].view(np.int64), mixed[1][at].view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    return text_rows(docs).withColumn("text_key", F.xxhash64("text"))


def spans(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, text_key, place, later) of every run; ``later``: an earlier one of its batch has its hash.

    A row that is later has random numbers for a hash, since it needn't meet any other.
    """

    def apply(d: dict) -> dict:
        ids, keys = d["doc_id"], d["text_key"]
        one = {(ids[i] is None, ids[i] or 0, keys[i]): i for i in range(len(ids))}
        docs = [one[k] for k in sorted(one)]
        found = [runs(d["text"][i]) for i in docs]
        which = pa.array(np.repeat(docs, [len(f[0]) for f in found]))
        at, h1, h2 = (np.concatenate([f[k] for f in found]) for k in range(3))
        order = np.argsort(h1, kind="stable")
        same = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
        later = np.zeros(len(at), dtype=bool)
        later[order[1:][same]] = True
        h1[later] = np.random.default_rng([len(at), keys[0] & 2**63 - 1]).integers(-2**63, 2**63 - 1, int(later.sum()))
        return {"h1": pa.array(h1), "h2": pa.array(h2), "doc_id": pa.array(ids, pa.int64()).take(which),
                "text_key": pa.array(keys, pa.int64()).take(which), "place": pa.array(at.astype(np.int32)), "later": pa.array(later)}

    return map_batches(keyed(docs), apply, "h1 long, h2 long, doc_id long, text_key long, place int, later boolean")


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, places): the starts of the runs of each document that are not the first."""
    # Equal rows have one rank, so that they don't remove each other.
    order = ["later", F.col("doc_id").isNull(), "doc_id", "text_key", "place"]
    ranks = spans(docs).withColumn("rank", F.rank().over(Window.partitionBy("h1", "h2").orderBy(*order)))
    again = ranks.where("later OR rank > 1")
    return again.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))


def cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text without repeated passages, n_units, n_removed) of every row of ``docs``."""
    rows, again = keyed(docs), covered(docs)
    mine = rows.join(again.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"}),
                     rows.doc_id.eqNullSafe(F.col("__id")) & (rows.text_key == F.col("__key")), "left")

    def apply(d: dict) -> dict:
        texts, counts, removed = [], [], []
        for text, places in zip(d["text"], d["places"]):
            ends, words = units(text)
            gone = in_passages(places or (), list(map(len, words)))
            if gone:
                text = "".join(text[a:b] for i, (a, b) in enumerate(zip([0, *ends], ends)) if i not in gone)
            texts.append(text)
            counts.append(len(ends))
            removed.append(len(gone))
        return {"doc_id": d["doc_id"], "text_key": d["text_key"], "text": texts, "n_units": counts, "n_removed": removed}

    return map_batches(mine.select("doc_id", "text_key", "text", "places"), apply,
                       "doc_id long, text_key long, text string, n_units int, n_removed int")


def in_passages(places: Iterable[int], sizes: list[int]) -> set[int]:
    """The units covered by the runs that begin at ``places``, but for stretches of fewer than LEAST_SPAN words; ``sizes``
    are the units' words."""
    out: set[int] = set()
    stretch: list[int] = []
    for u in sorted({p + i for p in places for i in range(RUN)}):
        if stretch and u != stretch[-1] + 1:
            out.update(stretch if sum(sizes[v] for v in stretch) >= LEAST_SPAN else ())
            stretch = []
        stretch.append(u)
    out.update(stretch if sum(sizes[v] for v in stretch) >= LEAST_SPAN else ())
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns text and n_chars (where there is one) as they are after the removal."""
    new = cleaned(docs).where("n_removed > 0").select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("text").alias("__text")).distinct()
    same = docs["doc_id"].eqNullSafe(new["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == new["__key"])
    out, changed = docs.join(new, same, "left"), F.col("__text").isNotNull()
    if "n_chars" in docs.columns:
        n = F.length("__text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, n).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.when(changed, F.col("__text")).otherwise(F.col("text"))).select(*docs.columns)


@query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    """Every document with its text as it is without repeated passages."""
    return cleaned(read_table(spark, sf_dir, "documents")).drop("text_key")
