"""Operator 4: grammars round trip, ranges decode alone, and the files hold every document in order."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from inkwell.llm import token_files as R
from inkwell.llm.tokens import hf_encoder
from tests.conftest import SMALL


def sequences():
    rng = random.Random(3)
    yield from ([], [5], [5, 5], [7] * 1000, [7] * 1001, [1, 2] * 500, [1, 2, 3] * 333 + [1], list(range(3000)))
    for n, top in ((50, 3), (5000, 4), (20_000, 50), (40_000, 49_408)):
        yield [int(min(top - 1, rng.paretovariate(0.7))) for _ in range(n)]
    phrase = [rng.randrange(49_408) for _ in range(40)]
    yield [x for _ in range(200) for x in (phrase[: rng.randrange(10, 40)] + [rng.randrange(49_408)])]


def test_round_trip_and_ranges():
    rng = random.Random(1)
    for ids in sequences():
        g = R.re_pair(np.array(ids, dtype=np.int64))
        assert g.ids().tolist() == ids
        assert g.widths(g.sequence).sum() == len(ids)
        for k, (a, b) in enumerate(zip(g.left, g.right)):
            assert len(g.expand(np.array([R.BASE + k]))) == g.expansion[k] and a < R.BASE + k and b < R.BASE + k
        for _ in range(20):
            a = rng.randrange(len(ids) + 2)
            b = a + rng.randrange(50)
            assert g.ids(a, b).tolist() == ids[a:b]
    assert len(R.re_pair(np.array([1, 2, 3, 4] * 2000)).sequence) < 2000 * 4 / 8


ROWS = [(9, "b " * 400), (3, "hello World, hello world"), (3, "again"), (1, None), (2, ""), (None, "no id"), (8, "x" * 50_000), (7, "hello World, hello world")]


def expected(rows):
    t, at, out = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1, b"k") for r in ROWS], "doc_id long, text string, part int, ids binary")
    path = str(tmp_path / "files")
    R.write_tokens(df, path, hf_encoder("word_bpe_49k.json", keeps_space=False), 1, shard=100)
    rows = R.read_tokens(spark, path).collect()
    got = sorted([(r.start, r.doc_id, len(r.ids) // 4, zlib.crc32(r.ids)) for r in rows])
    assert [g[0] for g in got] == np.cumsum([0, *[g[2] for g in got]])[:-1].tolist()
    assert got[0][1] is None and [g[1] for g in got[1:]] == [1, 2, 3, 3, 7, 8, 9]
    want = {(i, n, c) for i, _, n, c in expected(ROWS)}
    assert {(i, n, c) for _, i, n, c in got} == want
    files = spark.read.parquet(path)
    big = files.orderBy(files.n_ids.desc()).limit(1)
    whole = R.read_range(big, 0, 1 << 40)
    assert R.read_range(big, 10, 60) == whole[10:60]


def test_query_in_order(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    assert sorted(map(tuple, R.op4_token_files(spark, SMALL).collect())) == expected(docs)


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    R.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, hf_encoder("word_bpe_49k.json", False), 1)
    assert R.read_tokens(spark, path).count() == 0


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(6)
    zipf = np.minimum(rng.zipf(1.3, 200_000), 50_000)
    copies = np.tile(rng.integers(0, 50_000, 3000), 40)
    for ids in (zipf, copies):
        g = R.re_pair(ids)
        assert (g.ids() == ids).all()
        a, b = g.sequence[:-1], g.sequence[1:]
        pairs, times = np.unique(a[a != b] << 32 | b[a != b], return_counts=True)
        assert not len(pairs) or times.max() < R.LEAST
    assert len(g.sequence) <= 40
