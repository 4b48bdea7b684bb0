"""Findings of round 7: products of blocks, rounded pairs, calls to the state of live counts."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inkwell.operators import recommend as H
from inkwell.operators import similarity as S
from inkwell.streaming import keyed as K


@pytest.mark.parametrize("threshold,strict", [(0.5, True), (0.5, False), (0.0, False), (0.9, True)])
def test_blocks_meet_by_slices_of_time(monkeypatch, threshold, strict):
    """Slices beyond the window aren't multiplied, and a cosine is told in double precision where single is too coarse."""
    monkeypatch.setattr(S, "SLICE", 16)
    rng = np.random.default_rng(3)
    u = rng.normal(size=(300, 8))
    u[:40] = [3, 4, 0, 0, 0, 0, 0, 0]
    for k in range(40):  # cosines to the rows before that differ from 0.5 by one part in 1e12 and more
        u[100 + k] = np.r_[0.3, 0.4, np.sqrt(0.75) * (1 + (k - 20) * 1e-12), np.zeros(5)]
    u /= np.linalg.norm(u, axis=1)[:, None]
    lo = rng.integers(0, 200, 300)
    lo[150:] += 130
    rows = {"id": np.arange(300) % 290, "lo": lo, "hi": lo + rng.integers(0, 3, 300), "blk": rng.integers(0, 3, 300) + np.arange(300) // 150 * 9,
            "side": (np.arange(300) // 150).astype(np.int32), "own": np.arange(300) < 150}
    table = pa.table({**rows, "u": u.tolist()})
    products, real = [], np.matmul
    monkeypatch.setattr(S.np, "matmul", lambda a, b, out: products.append(a.shape[0] * b.shape[1]) or real(a, b, out=out))
    got = sorted((a, b, round(s, 9)) for x in S._meet(100, threshold, strict, True, False)(iter(table.to_batches(37)))
                 for a, b, s in zip(*(c.to_pylist() for c in x.columns)))
    s, ids = u @ u.T, rows["id"]
    hit = s > threshold if strict else s >= threshold
    want = sorted((min(ids[i], ids[j]), max(ids[i], ids[j]), round(s[i, j], 9)) for i in range(150) for j in range(i + 1, 300)
                  if hit[i, j] and rows["lo"][j] - rows["hi"][i] <= 100 and rows["lo"][i] - rows["hi"][j] <= 100 and ids[i] != ids[j])
    assert got == want and want
    assert 0 < sum(products) < 0.85 * (150 * 150 + 150 * 150 / 2)


def test_pairs_of_a_slot_share_its_calls():
    """A batch reads and writes a slot's state once, however many pairs of user and item it has."""
    held, calls = [], []
    state = SimpleNamespace(get=lambda: calls.append("get") or (held[-1] if held else None), update=lambda x: calls.append("update") or held.append(x))
    live = K.LiveState()
    live.init(SimpleNamespace(getValueState=lambda *_: state))
    event = Row("slot", "action", *(c for c in K.LiveState.IN if c != "action"))

    def batch(*events):
        rows = [event(5, action, user, item, n, us, action.removeprefix("un")) for n, us, user, item, action in events]
        return {(r.user_id, r.item_id): (r.version, r.reads, r.likes, r.like_active, r.like_us, r.bookmarks) for r in live.handleInputRows((5,), iter(rows), None)}

    first = batch((1, 10, 1, 1, "like"), (2, 30, 1, 2, "read"), (3, 20, 1, 1, "unlike"), (4, 5, None, 2, "read"), (5, 5, 1, 2, "read"))
    assert first == {(1, 1): (1, 0, 0, False, 20, 0), (1, 2): (1, 2, 0, None, None, 0), (None, 2): (1, 1, 0, None, None, 0)}
    second = batch((6, 15, 1, 1, "like"), (7, 40, 1, 2, "like"), (8, 41, 3, 3, "bookmark"))
    assert second == {(1, 1): (2, 0, 0, False, 20, 0), (1, 2): (2, 0, 1, True, 40, 0), (3, 3): (1, 0, 0, None, None, 1)}
    assert batch((9, 50, 1, 2, "unlike"), (10, 60, None, 2, "like")) == {(1, 2): (3, 0, -1, False, 50, 0), (None, 2): (2, 0, 1, True, 60, 0)}
    assert calls == ["get", "update"] * 3


def test_scores_are_rounded_once_a_category(spark):
    """Rounded parts and scores are those of pairs rounded one by one; no pair's content score is rounded by itself."""
    profile = spark.createDataFrame([(u, c, (u * 7 + i * 3) % 5 - 0.9) for u in range(6) for i, c in enumerate("abz")] + [(8, "b", None)],
                                    "user_id long, category_slug string, affinity double")
    items = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(12)] + [(None, "a"), (3, "a")], "article_id long, category_slug string")
    cf = spark.createDataFrame([(u, i, float(u + i) / 5 - 0.4) for u in range(1, 7) for i in (u, u + 1, 99)], "user_id long, item_id long, cf_score double")
    speed = spark.createDataFrame([(0, 0.7), (3, 2.0), (77, 1.1)], "item_id long, velocity double")
    offered = spark.createDataFrame([(u, i) for u in range(8) for i in (0, 3, 5, 77)], "user_id long, article_id long")

    def rows(df):
        return sorted(map(str, df.collect()))

    plain = H.hybrid_over_categories(profile, items, cf, speed, offered)
    want = plain.select("user_id", "article_id", *(F.round(c, 2).alias(c) for c in plain.columns[2:]))
    assert rows(H.hybrid_over_categories(profile, items, cf, speed, offered, digits=2)) == rows(want)
    content = H.content_scores(profile, items)
    few = H.content_scores(profile, items, digits=2)
    assert rows(few) == rows(content.withColumn("content_score", F.round("content_score", 2))) and few.count() > 40
    lines = few._jdf.queryExecution().optimizedPlan().toString().split("Join")
    assert "round(" not in lines[0] and "round(" in "".join(lines[1:])
