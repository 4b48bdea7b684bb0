"""Operators 5 and 10: held-out accuracy, what may be learned from, odd texts and tables."""

import zlib

import numpy as np

from inkwell.llm import langid as L
from inkwell.llm import toxicity as T
from inkwell.llm.common import in_key
from tests.conftest import MID

DOCS = "doc_id long, text string, lang string"


def test_in_key(spark):
    got = {r.doc_id: r.k for r in spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").withColumn("k", in_key(2, 4)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)} | {None: False}


def test_language_accuracy(spark):
    got = {r.doc_id: r for r in L.op5_langid(spark, MID).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    assert got.keys() == docs.keys() and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in got.values() if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.95


def test_language_fit_sees_no_held_out_row(spark):
    rows = [(i, f"wort{i} " * 30, "in" if zlib.crc32(str(i).encode()) % 4 != 2 else "out") for i in range(40)] + [(None, "null id", "none")]
    assert set(L.fit(spark.createDataFrame(rows, DOCS), in_key(2, 4))) == {"in"}


def test_language_of_odd_texts(spark):
    rows = [(1, "the house of the old man and the sea", "en"), (2, "la maison de la vieille et de la mer", "fr"), (3, None, "en"), (4, "", "fr"),
            (5, "123 !?", "en"), (6, "the man and the sea of the house", None), (6, "the man and the sea of the house", None),
            (None, "la mer et la maison de", "xx"), (7, "the sea and the man " * 20_000, None), (8, "١٢٣ 😀", None)]
    df = spark.createDataFrame([(*r, 0.5, "k") for r in rows], DOCS + ", score double, rejected string")
    got = sorted([(r.doc_id, r.lang_pred) for r in L.predict(df, L.fit(df)).collect()], key=repr)
    assert got == sorted([(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en"), (None, "fr"), (7, "en"), (8, "und")], key=repr)
    assert [r.lang_pred for r in L.predict(df.where("doc_id = 1"), {}).collect()] == ["und"]
    assert L.predict(df.limit(0), L.fit(df.limit(0))).count() == 0


def made(n, seed):
    """Rows with two bad words in every fifth text, one of them with ever new endings."""
    rng, rows = np.random.default_rng(seed), []
    vocab = np.array([f"w{i}" for i in range(3000)])
    for i in range(n):
        words = list(rng.choice(vocab, rng.integers(5, 120)))
        if bad := i % 5 == 0:
            words[rng.integers(len(words))] = f"Nasty{rng.integers(10 ** 6)}!" if i % 2 else "awful,"
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_learns_words_and_stems(spark):
    rows = made(4000, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    w = T.train(df.drop("toxic"), df.drop("text"), in_key(1, 3))
    got = {r.doc_id: r.score for r in T.score(df, w).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((s >= T.CUT) == bool(y) for s, y in held)
    assert 0 < w.count() < 5000


def test_ftrl_matches_plain_steps():
    rng = np.random.default_rng(0)
    rows = [(rng.choice(16, 3, replace=False), int(rng.random() < .5)) for _ in range(40)]
    m = T.Ftrl(bits=4, l1=0.3, full=1)
    z, n = {}, {}

    def weight(f):
        l1 = 0 if f == 16 else 1.0
        zf, nf = z.get(f, 0.0), n.get(f, 0.0)
        return 0.0 if abs(zf) <= l1 else -(zf - np.sign(zf) * l1) / ((m.beta + nf ** .5) / m.alpha + m.l2)

    for _ in range(2):
        for x, y in rows:
            own = [*sorted(x.tolist()), 16]
            ws = {f: weight(f) for f in own}
            g = (1 / (1 + np.exp(-sum(ws.values()))) - y) * (m.toxic if y else 1)
            for f in own:
                new = n.get(f, 0.0) + g * g
                z[f] = z.get(f, 0.0) + g - (new ** .5 - n.get(f, 0.0) ** .5) / m.alpha * ws[f]
                n[f] = new
    assert np.allclose(m.fit(rows, 2), [weight(f) for f in range(17)])


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "!!", 1), (3, "a b", 1), (None, "c", 1), (4, "x " * 200_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (2, 3), (None, 1), (9, 1)], "doc_id long, toxic int")
    w = T.train(docs, labels)
    assert w.count() == 0
    assert sorted([(r.doc_id, r.score) for r in T.score(docs, w).collect()], key=repr) == sorted([(1, 0.0), (2, 0.0), (3, 0.0), (3, 0.0), (None, 0.0), (4, 0.0)], key=repr)
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (1, 0)], "doc_id long, toxic int")
    out = T.score(docs, T.train(docs, labels)).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert T.score(docs.limit(0), w).count() == 0


def test_drop_toxic_keeps_columns(spark):
    rows = made(2000, 2)
    docs = spark.createDataFrame([(i, t, "s", [1]) for i, t, _ in rows] + [(None, None, None, None)], "doc_id long, text string, source string, more array<int>")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = T.drop_toxic(docs, labels)
    assert out.schema == docs.schema
    kept = {r.doc_id for r in out.collect()}
    assert None in kept and {i for i, _, y in rows if not y} <= kept
    assert len([i for i, _, y in rows if y and i in kept]) <= 0.02 * 400
