"""Whole texts to ids, with one call to the encoder proper for each chunk not seen before.

The public vocabularies used here split a text at a single space between other characters: the
byte-level ones keep the space with what follows, the word one drops it. So a text's ids are those of
its chunks in a row: texts are split by Arrow, each different chunk is looked up once, and the ids are
gathered by place. A worker keeps the ids of the chunks that it met last, about ``MEMO`` bytes of them. The
byte-level split has one exception: a space before more white space or at the end. Texts with such a space
are encoded whole.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from inkwell.llm.common import worker_memo

#: Bytes of chunks and their ids that a worker keeps, and characters that are split at a time.
MEMO, AT_A_TIME = 48 << 20, 1 << 23


def vocabulary(name: str) -> str:
    """A path is taken as it is, a bare file name from the folder of public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class Memo:
    """A dictionary of bounded bytes in two generations: when the young one holds half of ``size``, it becomes the old
    one and the one before is dropped; what is asked for is young again."""

    #: Bytes of an entry besides its characters: a string, a bytes object and their places.
    ENTRY = 200

    def __init__(self, size: int):
        self.size, self.young, self.old, self.used = size, {}, {}, 0

    def missing(self, keys) -> set:
        """The ``keys`` that are not held; the others are in ``young`` until the next call of ``turn``."""
        young, old, out = self.young, self.old, set()
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = v = old[k]
                    self.used += self.ENTRY + len(k) + len(v or b"")
                else:
                    out.add(k)
        return out

    def update(self, pairs) -> None:
        young = self.young
        for k, v in pairs:
            young[k] = v
            self.used += self.ENTRY + len(k) + len(v or b"")

    def turn(self) -> None:
        if self.used > self.size // 2:
            self.young, self.old, self.used = {}, self.young, 0


class Chunked:
    """Encodes lists of texts into bytes of little-endian unsigned 32-bit ids.

    ``encode`` does so for any texts; ``keeps_space`` says whether a chunk keeps the space before it.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], keeps_space: bool, memo: int = MEMO):
        self.encode, self.space = encode, " " if keeps_space else ""
        self.first = Memo(memo // 4)  # chunks at the start of a text
        self.later = Memo(memo)  # chunks behind a space; None: not safe to take alone

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < AT_A_TIME:
                size += len(texts[to])
                to += 1
            out += self._some(texts[at:to])
            at = to
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        self.first.turn()
        self.later.turn()
        parts = pc.split_pattern(pa.array(texts, type=pa.large_string()), " ")
        text_at = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = coded.indices.to_numpy().astype(np.int64)
        first = [chunks[c] for c in code[text_at[:-1]].tolist()]
        self._learn(self.first, self.first.missing(first), "")
        self._learn(self.later, self.later.missing(chunks), self.space)
        # Entry c holds the ids of chunk c behind a space, the entries after those the first chunk of each text.
        code[text_at[:-1]] = np.arange(len(chunks), len(chunks) + len(texts))
        entries = [*map(self.later.young.__getitem__, chunks), *map(self.first.young.__getitem__, first)]
        whole = np.logical_or.reduceat(np.array([e is None for e in entries])[code], text_at[:-1])
        entries = [e or b"" for e in entries]
        ids = np.frombuffer(b"".join(entries), dtype="<u4")
        sizes = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries)) // 4
        size, begin = sizes[code], (np.cumsum(sizes) - sizes)[code]
        ends = np.cumsum(size)
        raw = ids[np.repeat(begin - (ends - size), size) + np.arange(int(size.sum()))].tobytes()
        cuts = np.r_[0, ends[text_at[1:] - 1] * 4].tolist()
        return [self.encode([t])[0] if w else raw[a:b] for t, w, a, b in zip(texts, whole.tolist(), cuts, cuts[1:])]

    def _learn(self, memo: Memo, new: set[str], space: str) -> None:
        if space:
            unsafe = {c for c in new if not c or c[0].isspace()}
            memo.update((c, None) for c in unsafe)
            new -= unsafe
        # A word with one mark behind it is the word's ids and the mark's.
        marked = {c for c in new if c[-1:] in (".", ",") and c[:-1].isalpha()}
        plain = list((new - marked) | memo.missing({c[:-1] for c in marked}))
        words = [c for c in plain if c.isalpha()] if space or not self.space else []
        if len(words) > 1:
            memo.update(zip(words, self._words(words)))
            plain = [c for c in plain if not c.isalpha()]
        for at in range(0, len(plain), 20_000):
            part = plain[at:at + 20_000]
            memo.update(zip(part, self.encode([space + c for c in part])))
        if marked:
            mark = dict(zip(".,", self.encode([".", ","])))
            memo.update((c, memo.young[c[:-1]] + mark[c[-1]]) for c in marked)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words behind a space, many in one text with a full stop behind each. Where a word's ids hold
        the stop's own, the number of stops tells, and those words are encoded one by one."""
        stop, out = np.frombuffer(self.encode(["."])[0], dtype="<u4"), []
        parts = [words[at:at + 1_000] for at in range(0, len(words), 1_000)]
        texts = ["".join(f" {w}." for w in part) for part in parts]
        for part, raw in zip(parts, self.encode(texts)):
            ends = np.flatnonzero(np.frombuffer(raw, dtype="<u4") == stop[0]) * 4 if len(stop) == 1 else []
            if len(ends) == len(part):
                out += [raw[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist())]
            else:
                out += self.encode([" " + w for w in part])
        return out


def _library(path: str) -> Callable[[list[str]], list[bytes]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)

    def encode(texts: list[str]) -> list[bytes]:
        found = (e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False))
        return [struct.pack(f"<{len(i)}I", *i) for i in found]

    return encode


def hf_encoder(name: str, keeps_space: bool = True, memo: int = MEMO) -> Callable[[], Chunked]:
    """A function that gives the worker's own encoder; only the path travels to the workers."""
    path = vocabulary(name)
    return lambda: worker_memo((path, keeps_space, memo), lambda: Chunked(_library(path), keeps_space, memo))


def end_cut(encoded: list[bytes], end_id: int) -> list[bytes]:
    """Each document's ids with the end id behind them."""
    end = struct.pack("<I", end_id)
    return [ids + end for ids in encoded]
