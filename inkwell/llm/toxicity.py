"""Operator 10: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, the words' first ``STEM`` letters, word pairs, and pairs with
one or two words between, hashed to ``2 ** bits`` places. Training takes labelled rows up to about
``sample`` of them, chosen by a hash of doc_id, dealt to shards of about ``PER_SHARD``; each shard runs
FTRL-proximal (per-coordinate rates, L1 and L2) over its rows, and the shards' weights are averaged. L1
leaves most weights at zero, so the model is a list of (place, weight) of at most ``2 ** bits`` rows, small
enough to send to every worker. Scoring reads whole texts once, without a shuffle.

Null or empty text, or text without words, has no features and scores the bias. Labels other than 0 and
1, null labels and null doc_ids are not learned from; a doc_id labelled both ways counts as toxic.
Without any row to learn from every score is 0. Repeated rows are all returned. Only doc_id and text of
the documents, and doc_id and toxic of the labels, are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import in_key, map_batches, map_groups, slices, text_rows, worker_memo
from inkwell.llm.registry import query
from inkwell.sources.tables import read_table

#: Labelled rows to learn from, rows of a shard, passes of a shard over its rows, and a stem's letters.
SAMPLE, PER_SHARD, EPOCHS, STEM = 24_000, 8_000, 4, 5
#: Score from which a document counts as toxic.
CUT = 0.7
#: Words that a worker keeps the hash of.
MEMO = 100_000

_MARKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """Two hashes of a word: its own and its stem's."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > MEMO:
            self.clear()
        stem = word.decode()[:STEM].encode()
        self[word] = h = (xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(stem, seed=STEM))
        return h


def features(text: str, bits: int) -> np.ndarray:
    """Places of all words, stems and (skip) pairs of ``text``, with repeats. ASCII marks split words."""
    words = text.lower().encode().translate(_MARKS).split()
    if not words:
        return np.zeros(0, dtype=np.int32)
    hashes = worker_memo(_Hashes, _Hashes)
    h, stems = np.array([hashes[w] for w in words], dtype=np.uint64).T
    pairs = [h[:-gap] * _STEPS[gap - 1] + h[gap:] for gap in (1, 2, 3) if len(h) > gap]
    return (np.concatenate([h, stems, *pairs]) * _MIX >> np.uint64(64 - bits)).astype(np.int32)


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: the per-coordinate rate; l1, l2: the penalties; toxic: weight of a toxic row.

    l1 is that of a shard of ``full`` rows and more; with fewer rows it is less in proportion, 1 at least.
    Place ``2 ** bits`` is the bias.
    """

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    toxic: float = 2.0
    full: int = 6_000

    def fit(self, rows: Iterable[tuple[np.ndarray, int]], epochs: int) -> np.ndarray:
        bias = 1 << self.bits
        rows = [(np.append(np.unique(x), np.int32(bias)), y) for x, y in rows]
        l1 = max(1.0, self.l1 * min(1.0, len(rows) / self.full))
        z, n, penalty = np.zeros(bias + 1), np.zeros(bias + 1), np.full(bias + 1, l1)
        penalty[bias] = 0
        for _ in range(epochs):
            for x, y in rows:
                w = self.weights(z[x], n[x], penalty[x])
                g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (self.toxic if y else 1.0)
                root = np.sqrt(n[x])
                n[x] += g * g
                z[x] += g - (np.sqrt(n[x]) - root) / self.alpha * w
        return self.weights(z, n, penalty)

    def weights(self, z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def train(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, model: Ftrl = Ftrl(),
          sample: int = SAMPLE) -> DataFrame:
    """(place, weight) of the non-zero weights, learned from rows that are not ``held_out``."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    if held_out is not None:
        known = known.where(~held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = known.count()
    chance = min(1.0, sample / max(1, labelled))
    shards = max(1, round(min(sample, labelled) / PER_SHARD))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # The same hash on both sides: a document outside the sample is never shuffled.
    some = known.where(place < int(chance * (1 << 30)))
    texts = text_rows(docs).where(F.col("doc_id").isNotNull() & (place < int(chance * (1 << 30))))
    rows = texts.join(some, "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))

    def prepare(d: dict) -> dict:
        return {"shard": d["shard"], "toxic": d["toxic"], "places": [features(t, model.bits).tobytes() for t in d["text"]],
                "turn": [xxhash.xxh64_intdigest(f"{i} {t}") - 2**63 for i, t in zip(d["doc_id"], d["text"])]}

    def fit(d: dict) -> dict:
        def take(i: int) -> tuple[np.ndarray, int]:
            places, d["places"][i] = d["places"][i], None  # a row's places aren't held twice
            return np.frombuffer(places, dtype=np.int32), d["toxic"][i]

        order = sorted(range(len(d["turn"])), key=d["turn"].__getitem__)
        w = model.fit(map(take, order), EPOCHS)
        at = np.flatnonzero(w)
        return {"place": at.tolist(), "weight": (w[at]).tolist(), "shard": [d["shard"][0]] * len(at)}

    # Texts become features before they are dealt to shards, so no task holds a shard's texts.
    featured = map_batches(rows, prepare, "shard int, toxic int, turn long, places binary")
    learned = map_groups(featured, ["shard"], fit, "place int, weight double, shard int")
    return learned.groupBy("place").agg((F.sum("weight") / shards).alias("weight"))


def scorer(spark, weights: DataFrame, model: Ftrl = Ftrl()) -> Callable[[list[str]], list[float]]:
    """Scores of texts by a model that every worker gets: at most 2 ** bits + 1 rows pass the driver."""
    found = weights.toArrow()
    table = np.zeros((1 << model.bits) + 1, dtype=np.float32)
    table[found["place"].to_numpy()] = found["weight"].to_numpy()
    learned, bias = len(found) > 0, float(table[-1])
    sent = spark.sparkContext.broadcast(table)

    def scores(texts: list[str]) -> list[float]:
        if not learned:
            return [0.0] * len(texts)
        w, out = sent.value, []
        for text in texts:
            x = features(text, model.bits)
            x = np.unique(x[w[x] != 0])
            out.append(float(1 / (1 + np.exp(-np.clip(bias + w[x].sum(dtype=np.float64), -35, 35)))))
        return out

    return scores


def score(docs: DataFrame, weights: DataFrame, model: Ftrl = Ftrl()) -> DataFrame:
    """(doc_id, score) of every whole text."""
    scores = scorer(docs.sparkSession, weights, model)
    return map_batches(text_rows(docs), lambda d: {"doc_id": d["doc_id"], "score": scores(d["text"])},
                       "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT, model: Ftrl = Ftrl()) -> DataFrame:
    """The rows of ``docs``, with all columns, that score below ``cut``; learns from all labelled rows
    up to the sample's size. Rows are filtered where they are read."""
    scores = scorer(docs.sparkSession, train(docs, labels, model=model), model)

    def clean(batches):
        for b in (part for whole in batches for part in slices(whole)):
            found = scores([t or "" for t in b.column("text").to_pylist()])
            yield b.filter(pa.array([s < cut for s in found], type=pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    """Every document's score; rows with crc32(doc_id) mod 3 = 1 are held out of training."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels, in_key(1, 3)))
    return out.select("doc_id", in_key(1, 3).alias("held_out"), "score",
                      (F.col("score") >= CUT).cast("int").alias("predicted"))
