"""Operator 6 against brute force: links, components, odd vectors, and windows narrower than a group."""

import math

import numpy as np
import pytest

from inkwell.llm import embedding_dedup as E
from tests.conftest import MID

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cut=E.CUT):
    x, ok = [], []
    for _, e, *_ in rows:
        good = bool(e) and None not in e and all(map(math.isfinite, e)) and any(e)
        ok.append(good)
        x.append(np.array(e, dtype=np.float32).astype(float) if good else None)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= cut:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low.setdefault(find(i), []).append(r[0])
    ids = [min((v for v in low[find(i)] if v is not None), default=None) for i in range(len(rows))]
    return sorted([(r[0], links[i], ids[i], r[0] == ids[i]) for i, r in enumerate(rows)], key=repr)


def got(df):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()], key=repr)


def groups(rng, dim=32):
    out = [rng.standard_normal(dim) for _ in range(300)]
    for size, noise in ((2, .02), (5, .03), (40, .04), (120, .05)):
        base = rng.standard_normal(dim)
        out += [base + noise * np.sqrt(dim) / 6 * rng.standard_normal(dim) for _ in range(size)]
    same = rng.standard_normal(dim)
    return [v.astype(np.float32).tolist() for v in out] + [same.astype(np.float32).tolist()] * 70


def test_brute_force_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), v, 0) for i, v in zip(rng.permutation(5000), groups(rng))]
    rows += [(6000, None, 1), (6001, [], 1), (6002, [0.0] * 32, 1), (6003, [float("nan")] * 32, 1), (6004, [1.0, None], 1),
             (6005, [float("inf")] + [0.0] * 31, 1), (6006, [1.0, 2.0], 1), (6007, [2.0, 4.0], 1), (6008, [1e-30, 2e-30], 1),
             (6009, [1.0], 1), (None, [2.0, 4.1], 1), (rows[0][0], rows[0][1], 1)]
    assert got(E.near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_groups_larger_than_windows_and_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v, 0) for i, v in enumerate(groups(rng))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(E.near_vectors(df, window=16, group=64, block=32)) == brute(rows)


def test_recall_on_given_table_and_empty(spark):
    df = spark.read.parquet(f"{MID}/embeddings.parquet")
    assert got(E.op6_embedding_dedup(spark, MID)) == brute([tuple(r) for r in df.collect()])
    assert E.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [3, 64])
def test_keys_are_in_lexicographic_order(dim):
    x = np.random.default_rng(3).standard_normal((50, dim))
    bits = x @ E.planes(dim, 2) > 0
    keys = E.signs(x, 2)
    for p in range(2):
        want = sorted(range(50), key=lambda i: (tuple(bits[i, p * 64:p * 64 + 64]), i))
        assert sorted(range(50), key=lambda i: (keys[i, p], i)) == want


@pytest.mark.parametrize("common, n", [(0, 100_000), (.5, 40_000)])
def test_pairs_at_the_cut_share_a_window_in_larger_tables(common, n):
    """Planted pairs at cosine 0.9 among vectors with and without a common direction; a narrow window stands for size."""
    rng, pairs, window = np.random.default_rng(4), 1000, 16
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    draw = lambda k: unit(np.sqrt(1 - common) * unit(rng.standard_normal((k, 64))) + np.sqrt(common) * np.eye(64)[0])
    x = draw(n)
    a, other = x[:pairs], draw(pairs)
    x[pairs:2 * pairs] = .9 * a + np.sqrt(1 - .81) * unit(other - (other * a).sum(1, keepdims=True) * a)
    middle = x.mean(axis=0)
    passes = E.passes_for(n, float(middle @ middle), window=window)
    assert passes > E.PASSES
    keys, met, place = E.signs(x - middle, passes), np.zeros(pairs, dtype=bool), np.empty(n, dtype=int)
    for p in range(passes):
        place[np.argsort(keys[:, p], kind="stable")] = np.arange(n)
        met |= abs(place[:pairs] - place[pairs:2 * pairs]) <= window
    assert met.mean() >= .985


def test_passes_grow_with_the_table_and_the_mean_is_taken_off(spark):
    assert E.passes_for(200, 0) == 1 and E.passes_for(10**5, 0) < E.passes_for(10**6, 0) < E.passes_for(10**7, 0)
    assert E.passes_for(10**6, 0) < E.passes_for(10**6, .5) and E.passes_for(10**6, 1) >= 10**6 / E.WINDOW
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(d) + 9).tolist()) for i, d in enumerate([8] * 70 + [5] * 30)]
    raw, kind = E.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = E.centres(raw.repartition(7), kind)
    assert {size: n for size, (n, _) in found.items()} == {8 * 8: 70, 5 * 8: 30}
    for size, (_, m) in found.items():
        x = np.array([v for _, v in rows if 8 * len(v) == size])
        assert np.allclose(m, (x / np.linalg.norm(x, axis=1, keepdims=True)).mean(axis=0))
