"""Operator 1: best-two-fit packing of tokenised documents into fixed-length sequences.

A document is its token ids and an end id. Documents longer than a sequence are cut into whole
sequences, of which the first may be shorter; each whole piece is a sequence of its own, so only the
first piece of a document is left to pack. Those are dealt to shards by a hash, and each shard fills one
sequence after another: the largest piece that fits goes in until none fits; then, if two unpacked
pieces together fill the space of the sequence's smallest piece plus its gap more tightly than that
piece, they take its place. With at most ``capacity`` distinct lengths, a shard holds its unpacked
pieces as one stack for each length and a bit set of the lengths that are left, so a choice takes a
few operations on that set.

A shard's size is bounded by ``per_shard`` documents on average (repeated rows fall into one shard); it
leaves at most one sequence unfilled for want of pieces. Null or empty text gives a document of the end
id alone. Repeated rows and equal doc_ids are packed as documents of their own; a null doc_id stays
null. An empty table gives no rows. Very long texts are tokenised whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import map_batches, map_groups, text_rows
from inkwell.llm.registry import query
from inkwell.llm.tokens import end_cut, hf_encoder
from inkwell.sources.tables import read_table

CAPACITY = 1024
PER_SHARD = 1 << 16


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers) for items of 1 to ``capacity``; ties go to the earlier item."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        stacks[lengths[i]].append(i)
    left = sum(1 << n for n, s in enumerate(stacks) if s)  # bit n: an item of length n is left
    mirror = sum(1 << (capacity - n) for n, s in enumerate(stacks) if s)

    def take(n: int) -> int:
        nonlocal left, mirror
        i = stacks[n].pop()
        if not stacks[n]:
            left ^= 1 << n
            mirror ^= 1 << (capacity - n)
        return i

    bins = []
    while left:
        gap, own = capacity, []
        while gap and (fits := left & ((2 << gap) - 1)):
            n = fits.bit_length() - 1
            own.append(take(n))
            gap -= n
        if gap and left and len(own) > 1:
            small = lengths[own[-1]]  # taken largest first
            for both in range(small + gap, small, -1):
                # Bit n of ``pairs``: items of lengths n and both - n are left.
                pairs = left & (mirror >> (capacity - both) if both <= capacity else mirror << (both - capacity))
                if both % 2 == 0 and pairs >> (both // 2) & 1 and len(stacks[both // 2]) < 2:
                    pairs ^= 1 << (both // 2)
                if pairs:
                    n = pairs.bit_length() - 1
                    back = own.pop()
                    own += [take(n), take(both - n)]
                    if not stacks[small]:
                        left |= 1 << small
                        mirror |= 1 << (capacity - small)
                    stacks[small].append(back)
                    break
        bins.append(own)
    return bins


def pieces(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[bytes]]], end_id: int,
           capacity: int, shards: int) -> DataFrame:
    """(doc_id, shard, length of the first piece, crc32 of each piece) for every document."""
    rows = text_rows(docs).withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    wide = 4 * capacity

    def cut(d: dict) -> dict:
        firsts, crcs = [], []
        for ids in end_cut(encoder()(d["text"]), end_id):
            first = (len(ids) - 1) % wide + 1
            at = [0, *range(first, len(ids) + 1, wide)]
            firsts.append(first // 4)
            crcs.append([zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:])])
        return {"doc_id": d["doc_id"], "shard": d["shard"], "first": firsts, "crcs": crcs}

    return map_batches(rows, cut, "doc_id long, shard int, first int, crcs array<long>", size=16 << 20)


def pack(docs: DataFrame, encoder: Callable, end_id: int, capacity: int = CAPACITY,
         per_shard: int = PER_SHARD) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    shards = max(1, -(-docs.count() // per_shard))

    def fill(d: dict) -> dict:
        order = sorted(range(len(d["first"])), key=lambda i: (d["doc_id"][i] is None, d["doc_id"][i] or 0, d["crcs"][i]))
        lengths = [d["first"][i] for i in order]
        sequence, offset = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        bins = best_two_fit(lengths, capacity)
        for b, own in enumerate(bins):
            at = 0
            for i in own:
                sequence[order[i]], offset[order[i]] = b, at
                at += lengths[i]
        whole = np.array([len(c) - 1 for c in d["crcs"]], dtype=np.int64)
        base = d["shard"][0] << 40
        return {"doc_id": d["doc_id"], "first": d["first"], "crcs": d["crcs"], "offset": offset.tolist(),
                "sequence": (base + sequence).tolist(),
                "whole_from": (base + len(bins) + whole.cumsum() - whole).tolist()}

    placed = map_groups(pieces(docs, encoder, end_id, capacity, shards), ["shard"], fill,
                        "doc_id long, first int, crcs array<long>, offset long, sequence long, whole_from long")
    head = F.col("piece") == 0
    before = F.col("first") + (F.col("piece") - 1) * F.lit(capacity).cast("long")
    return placed.select("*", F.posexplode("crcs").alias("piece", "ids_crc32")).select(
        "doc_id", "piece", F.when(head, 0).otherwise(before).cast("long").alias("start"),
        F.when(head, F.col("first")).otherwise(capacity).cast("long").alias("length"), "ids_crc32",
        F.when(head, F.col("sequence")).otherwise(F.col("whole_from") + F.col("piece") - 1).alias("sequence_id"),
        F.when(head, F.col("offset")).otherwise(0).cast("long").alias("offset"))


def pack_byte_bpe(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` with the byte-level tokenizer and end id 2 of the contract."""
    return pack(docs, hf_encoder("byte_bpe_50k.json" if path is None else path, memo=128 << 20), 2, capacity)


@query("op1_pack")
def op1_pack(spark, sf_dir):
    """All documents in sequences of at most 1024 tokens."""
    return pack_byte_bpe(read_table(spark, sf_dir, "documents"))
