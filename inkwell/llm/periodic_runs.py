"""Operator 12: runs of a period in the words of a text, by block convolution.

A run is a stretch of words of smallest period q (words q apart are equal), at least ``max(LEAST, TIMES * q)``
long, that no neighbouring word extends. For a scale B = 1, 2, 4, ... the words are cut into blocks of B; a run
of period q, B <= q < 2B, holds whole blocks that occur again q words later. So each block is laid against the
windows that begin B to 2B - 1 words behind it, all at once: the sum of squared differences of the words' numbers
is a convolution, computed exactly modulo a prime by a number-theoretic transform, and is zero where the block
occurs. (Words that differ can give a zero, equal ones can't miss it.) ``TIMES`` is so large that several blocks
in a row must occur at one distance; such a chain is a seed, and comparing words around it gives the
stretch and its ends, at most one block to each side. Multiples of a run's period find the same stretch, so of equal
stretches the least distance stays.

Texts of an Arrow batch are laid end to end with a number of its own between them, so that one transform serves
many texts; texts too short for a scale leave it. A text of n words takes ``n log(n) ** 2`` steps. Blocks
longer than ``BLOCK`` are replaced by several windows of that length.

Null or empty text and text of white space alone has no words and no runs. Repeated rows are all returned, a null
doc_id stays null, an empty table gives no rows, and only doc_id and text are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import map_batches, text_rows
from inkwell.llm.registry import query
from inkwell.sources.tables import read_table

#: A run is so many words and so many times its period at least.
LEAST, TIMES = 6, 4
#: A prime with transforms of up to 2 ** 21 places, and a generator of its units. A product of two residues, one
#: of them up to 15 times the prime, is exact in a double.
PRIME, ROOT = 11 * (1 << 21) + 1, 3
#: The longest block, the numbers that are transformed at a time, and the words that are searched at a time.
BLOCK, AT_ONCE, WORDS = 1 << 20, 1 << 15, 1 << 18


def _mod(x: np.ndarray) -> np.ndarray:
    """Residues, in place, of whole numbers below 2 ** 53: 0 to PRIME, and a few beyond either end for large numbers."""
    q = x * (1.0 / PRIME)
    np.floor(q, out=q)
    q *= PRIME
    x -= q
    return x


@lru_cache(maxsize=256)
def _twiddles(size: int, rows: int, inverse: bool) -> list[np.ndarray]:
    """For each step of ``rows`` transforms of ``size`` places, the powers of a root of unity."""
    out, n = [], size
    while n > 1:
        w = pow(ROOT, (PRIME - 1) // n, PRIME)
        if inverse:
            w = pow(w, PRIME - 2, PRIME)
        powers, filled = np.ones(n // 2), 1
        while filled < n // 2:
            powers[filled:2 * filled] = _mod(powers[:filled] * w)
            w = w * w % PRIME
            filled *= 2
        out.append(np.repeat(powers, rows))
        n //= 2
    return out


def forward(x: np.ndarray) -> np.ndarray:
    """Transforms of the columns of ``x`` (residues; a power of two of them each), in bit-reversed order."""
    size, rows = x.shape
    for k, w in enumerate(_twiddles(size, rows, False)):
        x = x.reshape(-1, 2, len(w))
        out = np.empty_like(x)
        a, b = x[:, 0], x[:, 1]
        np.add(a, b, out=out[:, 0])
        diff = a - b
        diff *= w
        out[:, 1] = _mod(diff)
        # Sums double with each step that they aren't reduced in.
        x = _mod(out) if k % 3 == 2 else out
    return _mod(x.reshape(size, rows))


def backward(x: np.ndarray) -> np.ndarray:
    """The columns whose ``forward`` is ``x``."""
    size, rows = x.shape
    for k, w in enumerate(reversed(_twiddles(size, rows, True))):
        x = x.reshape(-1, 2, len(w))
        out = np.empty_like(x)
        turned = _mod(x[:, 1] * w)
        np.add(x[:, 0], turned, out=out[:, 0])
        np.subtract(x[:, 0], turned, out=out[:, 1])
        x = _mod(out) if k % 8 == 7 else out
    x = _mod(x.reshape(size, rows))
    x *= pow(size, PRIME - 2, PRIME)
    return _mod(x)


def occurrences(codes: np.ndarray, starts: np.ndarray, block: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``starts``, distance) of all windows, ``first`` to ``first + block - 1`` behind a block, whose sum of
    squared differences to it is zero modulo the prime. ``codes`` are residues and reach as far as any window."""
    found_at, found_by = [], []
    most = max(1, AT_ONCE // (2 * block))
    square = _mod(codes * codes)
    for at in range(0, len(starts), most):
        s = starts[at:at + most]
        # A power of two of blocks, so that few sets of powers are needed; those beyond the last are repeated ones.
        columns = 1 << (len(s) - 1).bit_length()
        some = np.r_[s, np.repeat(s[:1], columns - len(s))]
        mine = some + np.arange(block)[:, None]
        window = some + first + np.arange(2 * block - 1)[:, None]
        # The block reversed, so that place block - 1 + t of the product is the window at t against the block.
        a = np.zeros((2 * block, columns))
        a[:block] = codes[mine[::-1]]
        b = np.zeros((2 * block, columns))
        b[:-1] = codes[window]
        product = backward(_mod(forward(a) * forward(b)))[block - 1:2 * block - 1]
        sums = np.cumsum(square[window], axis=0)
        squares = sums[block - 1:]
        squares[1:] -= sums[:block - 1].copy()
        rest = _mod(squares + square[mine].sum(axis=0) - 2 * product)[:, :len(s)]
        t, i = np.nonzero((rest == 0) | (rest == PRIME))
        found_at.append(i + at)
        found_by.append(t + first)
    return np.concatenate(found_at), np.concatenate(found_by)


def seeds(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, distances), scale by scale: chains of neighbouring blocks that occur again at one distance, long
    enough that a run could hold them. ``begins`` and ``sizes`` are the texts' places in ``codes``."""
    scale, longest, padded = 1, int(sizes.max(initial=0)), codes
    while max(LEAST, TIMES * scale) <= longest:
        block = min(scale, BLOCK)
        # Blocks that lie in texts long enough for this scale; a text's first and last block may reach over its end.
        long = np.flatnonzero(sizes >= max(LEAST, TIMES * scale))
        lo, hi = begins[long] // block, (begins[long] + sizes[long] - 1) // block + 1
        n = hi - lo
        numbers = np.unique(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
        pad = int(numbers[-1]) * block + 2 * scale + block - len(padded)
        if pad > 0:
            padded = np.r_[padded, np.zeros(pad)]  # no word has the number 0
        for first in range(scale, 2 * scale, block):
            at, by = occurrences(padded, numbers * block, block, first)
            yield _chains(numbers[at], by, block)
        scale *= 2


def _chains(number: np.ndarray, by: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((number, by))
    number, by = number[order], by[order]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (np.diff(by) != 0) | (np.diff(number) != 1)
    begin = np.flatnonzero(new)
    blocks = np.diff(np.r_[begin, len(by)])
    distance = by[begin]
    # A run's equal stretch is so long that it holds this many whole blocks wherever they begin.
    equal = np.maximum(LEAST - distance, (TIMES - 1) * distance)
    good = blocks >= np.maximum(1, (equal - block + 1) // block)
    start = number[begin[good]] * block
    return start, start + blocks[good] * block, distance[good]


def runs(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, by start and period. ``codes`` are the numbers of the words; what lies
    between two texts must equal nothing else."""
    least: dict[tuple[int, int], int] = {}
    total = len(codes)
    # The period and the end of a run that holds a place: a multiple of its period would only find it again.
    period, until = np.zeros(total + 1, dtype=np.int64), np.zeros(total + 1, dtype=np.int64)
    for chains in seeds(codes.astype(np.float64), begins, sizes):
        start, end, d = chains
        known = np.zeros(len(d), dtype=bool)
        for place in (start, (start + end) // 2, end - 1):
            q = period[np.minimum(place, total)]
            known |= (q > 0) & (d % np.maximum(q, 1) == 0) & (until[np.minimum(place, total)] >= end + d)
        for start, end, d in zip(*(x[~known].tolist() for x in chains)):
            # The blocks before and behind a chain don't occur at this distance: the stretch ends within them.
            reach = min(BLOCK, 1 << (d.bit_length() - 1))
            lo, hi = max(0, start - reach), min(total - d, end + reach)
            equal = np.zeros(max(0, hi - lo) + 2, dtype=bool)
            equal[1:-1] = codes[lo:hi] == codes[lo + d:hi + d]
            edges = np.flatnonzero(equal[1:] != equal[:-1])
            for a, b in zip((lo + edges[::2]).tolist(), (lo + edges[1::2] + d).tolist()):
                if b - a >= max(LEAST, TIMES * d):
                    least[a, b] = q = min(d, least.get((a, b), d))
                    period[a:b], until[a:b] = q, b
    return sorted((a, b, q) for (a, b), q in least.items())


def search(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start and period."""
    number: dict = defaultdict(count(1).__next__)
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    codes = np.empty(int((sizes + 1).sum()), dtype=np.int64)
    for i, (a, n, w) in enumerate(zip(begins.tolist(), sizes.tolist(), texts)):
        codes[a:a + n] = np.fromiter(map(number.__getitem__, w), dtype=np.int64, count=n)
        codes[a + n] = number[i]  # a key of its own kind: no word equals it
    out: list[list] = [[] for _ in texts]
    if len(number) >= PRIME:
        raise ValueError("more different words in one text than the prime can tell apart")
    found = runs(codes, begins, sizes)
    owner = np.searchsorted(begins, np.array([a for a, _, _ in found], dtype=np.int64), side="right") - 1
    for i, (a, b, q) in zip(owner.tolist(), found):
        out[i].append((a - int(begins[i]), b - a, q))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, with a space between."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, q in found:
        keep[start + q:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed): the runs (start, length, period) of every text by start and period, and the text
    without the words that repeat a run's first period."""

    def batch(d: dict) -> dict:
        found, short = [], []
        held, size = [], 0
        for i, t in enumerate(d["text"]):
            held.append(t.encode().split())
            size += len(held[-1])
            if size >= WORDS or i + 1 == len(d["text"]):
                some = search(held)
                found += [[{"start": a, "length": n, "period": q} for a, n, q in r] for r in some]
                short += [collapsed(w, r).decode() for w, r in zip(held, some)]
                held, size = [], 0
        return {"doc_id": d["doc_id"], "runs": found, "collapsed": short}

    return map_batches(text_rows(docs), batch,
                       "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a period put into every tenth text, as the id's checksum says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    some = text_rows(docs).withColumn("chosen", F.coalesce(h % 10 == 0, F.lit(False))).withColumn("h", h)
    # Only the chosen texts are split.
    some = some.withColumn("w", F.when(F.col("chosen"), words)).withColumn("n", F.size("w").cast("long"))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.expr("h div 10 % n")))
    some = some.withColumn("p", F.expr("1 + (n - a) div (3 + h div 10 % 8)"))
    new = F.expr("transform(w, (x, i) -> if(i < a, x, element_at(w, cast(1 + a + (i - a) % p as int))))")
    return some.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), F.array_join(new, " "))
                       .otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    """The runs of every text of documents, with the contract's planted periods."""
    found = find_runs(planted(read_table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # length / period as a whole part and a rest over the period: compared by cross products, so exactly.
    best = F.expr("""reduce(runs, cast(null as struct<start: long, length: long, period: long>), (b, r) ->
        if(b is null or r.length * b.period > b.length * r.period, r, b))""")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256)
                        .alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
