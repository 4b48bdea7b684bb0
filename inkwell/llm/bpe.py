"""Operator 3: byte-level BPE encoding and decoding with a two-tier lookup.

Every match of the pattern is a pre-token. A minimal perfect hash over the vocabulary resolves the
pre-tokens that are in it whole: one slot for each token and no more, so a slot's token is compared and
its id taken. The rest are merged by rank: a heap holds the pairs of neighbouring parts, parts are linked
both ways, and the pair of lowest rank (leftmost first) is joined until no pair has a rank.

Null or empty text gives no ids. Repeated rows are all returned, a null doc_id stays null, an empty
table gives no rows, and only doc_id and text are read. Texts are encoded whole; a run of n bytes
without a pre-token border costs n log n steps.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import map_batches, text_rows, worker_memo
from inkwell.llm.registry import query
from inkwell.llm.tokens import Chunked, Memo, vocabulary
from inkwell.sources.tables import read_table


#: Bytes of pre-tokens and their ids that a worker keeps, besides those of whole chunks.
MEMO = 16 << 20


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys take the slots 0 to n - 1.

    Keys fall into buckets; from the largest bucket on, the first displacement that puts all its keys
    into free slots is stored. Buckets of one key store their slot itself, as a negative number.
    """

    PER_BUCKET = 3

    def __init__(self, keys: list[bytes]):
        if len(set(keys)) != len(keys):
            raise ValueError("keys repeat")
        self.n = len(keys)
        self.buckets = max(1, self.n // self.PER_BUCKET)
        self.displace = np.zeros(self.buckets, dtype=np.int64)
        bucket, h = self._hashes(keys)
        free = np.ones(self.n, dtype=bool)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(ends)
        slots = np.zeros(self.n, dtype=np.int64)
        tries = np.arange(256, dtype=np.uint64)[:, None]
        for k in np.argsort(-sizes, kind="stable"):
            own = order[ends[k]:ends[k + 1]]
            if len(own) < 2:
                break
            d = 0
            while True:
                at = self._at(h[own], tries + np.uint64(d))
                good = free[at].all(axis=1)
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    break
                d += len(tries)
            found = int(good.argmax())
            slots[own], free[at[found]], self.displace[k] = at[found], False, d + found
        left = iter(np.flatnonzero(free).tolist())
        for k in np.flatnonzero(sizes == 1):
            slots[order[ends[k]]] = slot = next(left)
            self.displace[k] = -1 - slot
        self.keys = [b""] * self.n
        for i, s in enumerate(slots.tolist()):
            self.keys[s] = keys[i]

    def _hashes(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=">u8").reshape(-1, 2).astype(np.uint64)
        return ((h[:, 0] >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64), h[:, 1]

    def _at(self, h: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        x = h ^ (displacement * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> list[int]:
        """The slot of each key, -1 for what is no key."""
        if not keys or not self.n:
            return [-1] * len(keys)
        bucket, h = self._hashes(keys)
        d = self.displace[bucket]
        at = np.where(d < 0, -1 - d, self._at(h, np.maximum(d, 0).astype(np.uint64))).tolist()
        return [s if self.keys[s] == k else -1 for s, k in zip(at, keys)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece`` by rank, with a heap over linked parts."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is piece[i:end[i]]; 0: it is gone
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = end[i]
        # A stale entry names a part that is gone or a pair that has another rank by now.
        if not j or j >= n or ranks.get(piece[i:end[j]]) != r:
            continue
        end[i], end[j] = end[j], 0
        if (k := end[i]) < n:
            before[k] = i
            if (r := ranks.get(piece[i:end[k]])) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end[i]])) is not None:
            heapq.heappush(heap, (r, h))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


class TwoTier:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.hash = PerfectHash(list(ranks))
        self.id_of_slot = [ranks[k] for k in self.hash.keys]
        self.memo = Memo(MEMO)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.pattern.findall(t) for t in texts]
        self.memo.turn()
        new = list(self.memo.missing(set().union(*parts)))
        raw = [p.encode() for p in new]
        for p, key, slot in zip(new, raw, self.hash.slots(raw)):
            ids = [self.id_of_slot[slot]] if slot >= 0 else merge(key, self.ranks)
            self.memo.update([(p, b"".join(i.to_bytes(4, "little") for i in ids))])
        return [b"".join(map(self.memo.young.__getitem__, p)) for p in parts]


class Decoder:
    """Bytes of the ids of one file of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: k for k, i in ranks.items()}

    def __call__(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@dataclass(frozen=True)
class Codec:
    """Names a file of ranks; workers read it, whose size is that of the vocabulary."""

    path: str
    pattern: str

    def encoder(self) -> Chunked:
        return worker_memo((self, "encoder"), lambda: Chunked(TwoTier(read_ranks(self.path), self.pattern).encode, True))

    def decoder(self) -> Decoder:
        return worker_memo((self, "decoder"), lambda: Decoder(read_ranks(self.path)))


def bpe_codec(name: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> Codec:
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    return Codec(vocabulary(name), pattern)


def encode_documents(docs: DataFrame, codec: Codec | None = None) -> DataFrame:
    """(doc_id, ids) with the ids as little-endian unsigned 32-bit integers."""
    codec = codec or bpe_codec()
    return map_batches(text_rows(docs), lambda d: {"doc_id": d["doc_id"], "ids": codec.encoder()(d["text"])},
                       "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, codec: Codec | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for."""
    codec = codec or bpe_codec()
    return map_batches(encoded, lambda d: d | {"decoded": list(map(codec.decoder(), d["ids"]))},
                       "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, codec: Codec | None = None) -> DataFrame:
    """Encode, decode, and digest both."""
    back = decode_documents(encode_documents(docs, codec), codec)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_bpe")
def op3_bpe(spark, sf_dir):
    """Every text of documents to ids and back."""
    return round_trip(read_table(spark, sf_dir, "documents"))

