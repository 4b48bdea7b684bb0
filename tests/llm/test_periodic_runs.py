"""Operator 12 against brute force over all stretches and periods, and the transform against direct sums."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from inkwell.llm import periodic_runs as P
from tests.conftest import SMALL


def brute(words):
    """(start, length, period) of all runs: every stretch that no neighbour extends, by its smallest period."""
    n, out = len(words), {}
    for q in range(1, n // P.TIMES + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(P.LEAST, P.TIMES * q):
                out.setdefault((i, j - i + q), q)  # smaller periods come first
            i = max(j, i) + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def kept(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def made(rng, n, letters):
    out = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, q = rng.randrange(n + 1), rng.randrange(1, max(2, n // 4))
        unit = [rng.choice(letters) for _ in range(q)]
        out[a:a] = (unit * rng.randrange(1, 9))[:rng.randrange(1, 9 * q)]
    return [w.encode() for w in out]


def test_transform_is_exact():
    rng = np.random.default_rng(3)
    for size, rows in ((2, 1), (4, 5), (64, 3), (4096, 2), (1 << 17, 1)):
        x = rng.integers(0, P.PRIME, (size, rows)).astype(float)
        x[: size // 2, 0] = P.PRIME - 1
        back = P.backward(P.forward(x.copy()))
        assert ((back - x) % P.PRIME == 0).all()
    a, b = (rng.integers(0, P.PRIME, 32) for _ in range(2))
    pad = [np.r_[v, np.zeros(32)].astype(float)[:, None] for v in (a, b)]
    got = P.backward(P._mod(P.forward(pad[0]) * P.forward(pad[1])))[:, 0] % P.PRIME
    want = [sum(int(a[i]) * int(b[k - i]) for i in range(32) if 0 <= k - i < 32) % P.PRIME for k in range(64)]
    assert got.tolist() == want


@pytest.mark.parametrize("block", [1, 2, 8, 64])
def test_occurrences_are_all_found(block):
    rng = np.random.default_rng(block)
    codes = rng.integers(1, 3, 40 * block).astype(float)
    starts = np.arange(0, 30 * block, block)
    i, d = P.occurrences(codes, starts, block, block)
    want = {(k, t) for k, s in enumerate(starts) for t in range(block, 2 * block) if (codes[s:s + block] == codes[s + t:s + t + block]).all()}
    assert set(zip(i.tolist(), d.tolist())) == want


def test_search_equals_brute_force():
    rng = random.Random(12)
    for k in range(150):
        texts = [made(rng, rng.randrange(0, 90), "ab" if k % 3 else "abcdefgh") for _ in range(rng.randrange(1, 12))]
        assert P.search(texts) == [brute(t) for t in texts]
    long = [made(rng, 3000, "abc"), [b"x"] * 2000, made(rng, 50, "a"), [b"%d" % (i % 700) for i in range(3500)]]
    assert P.search(long) == [brute(t) for t in long]


def test_one_word_many_times():
    """Every multiple of the period finds the whole text: each is looked at once, not compared."""
    n = 200_000
    words = [b"a"] * n + [b"b"] + ([b"c"] * 8 + [b"d"]) * 1000
    assert P.search([words])[0][:2] == [(0, n, 1), (n + 1, 8, 1)]
    assert (n + 1, 9000, 9) in P.search([words])[0]


def test_short_blocks_and_false_zeros(monkeypatch):
    """Scales beyond the longest block, and a block that seems to occur everywhere."""
    rng = random.Random(5)
    texts = [made(rng, 200, "abcd") for _ in range(30)] + [[b"%d" % (i % 97) for i in range(600)]]
    want = [brute(t) for t in texts]
    monkeypatch.setattr(P, "BLOCK", 4)
    assert P.search(texts) == want
    monkeypatch.undo()
    real = P.occurrences

    def careless(codes, starts, block, first):
        i, d = real(codes, starts, block, first)
        more = np.arange(0, len(starts), 3)
        both = {*zip(i.tolist(), d.tolist()), *zip(more.tolist(), [first] * len(more))}
        return tuple(np.array(sorted(both), dtype=np.int64).reshape(-1, 2).T)

    monkeypatch.setattr(P, "occurrences", careless)
    assert P.search(texts) == want


def expected(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = min(found, key=lambda r: (-__import__("fractions").Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{a},{b},{q}\n" for a, b, q in found).encode()), sha(b" ".join(kept(words, found))))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def result(spark, monkeypatch, frame):
    monkeypatch.setattr(P, "read_table", lambda *_: frame)
    return sorted((tuple(r) for r in P.op12_periodic_runs(spark, "").select(COLUMNS).collect()), key=repr)


def test_query_on_small_table(spark):
    rows = P.read_table(spark, SMALL, "documents").select("doc_id", "text").collect()
    got = P.op12_periodic_runs(spark, SMALL)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_odd_rows(spark, monkeypatch):
    chosen = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (None, "b b b b b b"), (5, "b b b b b b"), (5, "b b b b b b"), (6, "x y " * 3 + "z"),
            (7, "x y\x0b" * 4), (8, "é é é " * 9), (9, "go " * 5), (10, "w " * 4_000), (11, " ".join(map(str, range(3_000)))),
            (None, None), *((i, t) for i in chosen for t in ("", "one", "p q r s t u v w x y z " * 7))]
    frame = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, h int, runs string")
    assert result(spark, monkeypatch, frame) == sorted((expected(i, t) for i, t in rows), key=repr)
    assert result(spark, monkeypatch, frame.limit(0)) == []
