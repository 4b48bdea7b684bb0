"""Comment threads by pointer doubling, and exact top inner products, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from inkwell import session
from inkwell.operators import recommend as H
from inkwell.operators import users as U


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: rounds.append(1) or real(df))
    n = 5_000
    chain = spark.range(n).select(F.col("id").alias("comment_id"), F.lit(1).cast("long").alias("item_id"),
                                  F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    got = U.comment_threads(chain).agg(F.count("*"), F.max("depth"), F.max("root_id"), F.sum("reply_count"),
                                       F.sum((F.size(F.split("path", "/")) == F.col("depth") + 1).cast("int"))).first()
    assert tuple(got) == (n, n - 1, 0, n - 1, n) and len(rounds) < 16


def test_forest_equals_walking_up(spark):
    rng = np.random.default_rng(2)
    parent = {i: None if i < 9 or rng.random() < .05 else int(rng.integers(max(0, i - 30), i)) for i in range(300)}
    parent |= {400: 401, 401: 402, 402: 400, 403: 402, 500: 999, 501: 500, 502: 502}  # a cycle, a missing parent, itself
    rows = [(i, i % 7, p) for i, p in parent.items()]
    df = spark.createDataFrame(rows, "comment_id long, item_id long, parent_id long")
    want, replies = {}, {}
    for i in parent:
        path, at = [i], i
        while parent[at] is not None and parent[at] in parent and len(path) < 400:
            at = parent[at]
            path.append(at)
        if parent[at] is None:
            want[i] = (path[-1], len(path) - 1, "/".join(map(str, path[::-1])))
            if parent[i] is not None:
                replies[parent[i]] = replies.get(parent[i], 0) + 1
    got = {r.comment_id: (r.root_id, r.depth, r.path) for r in U.comment_threads(df).collect()}
    assert got == want
    assert {r.comment_id for r in U.comment_rejects(df).collect()} == {400, 401, 402, 403, 500, 501, 502}
    assert {r.comment_id: r.reply_count for r in U.comment_threads(df).where("reply_count > 0").collect()} == replies
    gone = spark.createDataFrame([(3,)], "id long")
    assert {r.comment_id for r in U.comment_threads(df, gone).collect()} == {i for i, w in want.items() if "3" not in w[2].split("/")}


def test_top_products_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    users = [(i, rng.normal(size=6).tolist()) for i in range(70)] + [(900, [0.0] * 6)]
    items = [(i, (rng.normal(size=6) * rng.choice([.05, .5, 3])).tolist()) for i in range(200)] + [(500 + i, [1.0] * 6) for i in range(5)]
    seen = {(i, int(j)) for i, _ in users for j in rng.choice(200, int(rng.integers(0, 20)), replace=False)}
    seen |= {(0, j) for j, _ in items[:-3]} | {(1, j) for j, _ in items} | {(77, 3), (2, 7777)}  # a heavy reader, one who has seen all
    u, i = spark.createDataFrame(users, "user_id long, v array<float>"), spark.createDataFrame(items, "item_id long, v array<float>")
    s = spark.createDataFrame(sorted(seen), "user_id long, item_id long")
    f = {k: np.array(v, dtype=np.float32).astype(float) for k, v in items}
    want = {}
    for k, v in users:
        w = np.array(v, dtype=np.float32).astype(float)
        best = sorted((-round(float(w @ f[j]), 9), j) for j in f if (k, j) not in seen)[:10]
        want[k] = [(j, -x) for x, j in best]
    for rows in (16, 64, 4096):
        got = {}
        for r in H.top_products(u, i, s, 10, rows).orderBy("user_id", "rank").collect():
            got.setdefault(r.user_id, []).append((r.item_id, round(r.cf_score, 9)))
        assert {k: [j for j, _ in v] for k, v in got.items()} == {k: [j for j, _ in v] for k, v in want.items() if v}
        assert all(np.allclose([x for _, x in got[k]], [x for _, x in v]) for k, v in want.items() if v)
    assert H.top_products(u, i.limit(0), s, 10).count() == 0 and H.top_products(u.limit(0), i, s, 10).count() == 0
