"""Near-duplicate pairs and links against brute force, hot copies, and feeds' invariants."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import recommend as H
from inkwell.operators import similarity as S
from inkwell.operators import stories as T
from inkwell.operators.components import connected_components
from inkwell.plans import q_recommend as Q
from tests.conftest import MID

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "article_id long, publish_time timestamp_ntz, embedding array<double>"


def rows_of(rng, n, dim=8, clusters=4):
    centres = rng.normal(size=(clusters, dim))
    out = []
    for i in range(n):
        v = centres[i % clusters] * rng.uniform(.5, 2) + rng.normal(size=dim) * rng.choice([0, .3, 1])
        out.append((i, T0 + dt.timedelta(minutes=int(rng.integers(0, 9 * 1440))), v.tolist()))
    return out


def brute(left, right, threshold, hours, strict):
    out = {}
    for i, t, v in left:
        for j, s, w in right:
            if i != j and (left is not right or i < j) and v and w and t and s and abs((t - s).total_seconds()) <= hours * 3600:
                c = np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))
                if c > threshold if strict else c >= threshold:
                    out[i, j] = round(c, 9)
    return out


def got(df):
    rows = [((r.id_a, r.id_b), round(r.similarity, 9)) for r in df.collect()]
    assert len(rows) == len(dict(rows)), "a pair came twice"
    return dict(rows)


@pytest.mark.parametrize("threshold,block", [(0.9, 16), (0.3, 40), (-0.5, 4096)])
def test_pairs_equal_brute_force(spark, threshold, block):
    rng = np.random.default_rng(block)
    rows = rows_of(rng, 160)
    odd = [(900, T0, None), (901, T0, [0.0] * 8), (902, None, rows[0][2]), (903, T0, [float("nan")] + [1.0] * 7)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    assert got(S.near_dup_pairs(df, None, threshold, 48, rows_per_block=block)) == brute(rows, rows, threshold, 48, True)
    new, old = rows[:40], rows[40:]
    both = S.near_dup_pairs(spark.createDataFrame(new, SCHEMA), spark.createDataFrame(old, SCHEMA), threshold, 30, rows_per_block=block)
    assert got(both) == brute(new, old, threshold, 30, True)


def test_links_have_the_components_of_pairs(spark):
    rng = np.random.default_rng(1)
    rows = rows_of(rng, 120)
    rows += [(1000 + i, T0 + dt.timedelta(hours=11 * i), rows[i % 3][2]) for i in range(60)]  # copies, chains of them over time
    df = spark.createDataFrame(rows, SCHEMA)
    for threshold in (0.97, 0.8):
        pairs = connected_components(S.near_dup_pairs(df, None, threshold, 24, rows_per_block=32), None, "id_a", "id_b")
        links = connected_components(S.near_dup_links(df, threshold, 24, rows_per_block=32), None, "id_a", "id_b")
        assert sorted(map(tuple, links.collect())) == sorted(map(tuple, pairs.collect())) != []


def test_ten_thousand_equal_vectors_give_linear_links(spark):
    same = spark.range(10_000).select(F.col("id").alias("article_id"), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz").alias("publish_time"),
                                      F.array(*map(F.lit, [1.0, 2.0, 3.0])).alias("embedding"))
    links = S.near_dup_links(same)
    assert links.count() == 9_999
    assert T.dbscan_clusters(same).groupBy("cluster_id").count().collect()[0]["count"] == 10_000


def test_embedding_by_a_saved_model(spark, tmp_path):
    text = [(1, "alpha beta beta gamma"), (2, "alpha beta beta gamma"), (3, "delta epsilon zeta"), (4, ""), (5, None), (6, "unknown"), (7, "alpha")]
    docs = spark.createDataFrame(text, "article_id long, content string")
    S.fit_embedder(docs.where("article_id < 6")).write.parquet(str(tmp_path / "m"))
    model = spark.read.parquet(str(tmp_path / "m"))
    v = {r.article_id: r.embedding for r in S.embed(docs, model).collect()}
    assert v[1] == v[2] and np.isclose(np.linalg.norm(v[1]), 1) and v[4] is None and v[5] is None and v[6] is None and len(v) == 7
    one = {r.article_id: r.embedding for r in S.embed(docs.where("article_id = 1"), model).collect()}
    assert one[1] == v[1], "a batch changed what the model says"
    given = spark.createDataFrame([(1, [1.0] + [0.0] * 63), (99, [1.0] * 64)], "article_id long, embedding array<float>")
    w = {r.article_id: r.embedding for r in S.embed(docs, model, supplied=given).collect()}
    assert w[1] == [1.0] + [0.0] * 63 and 99 not in w and w[2] == v[2]


def test_feed_keeps_its_shares(spark):
    feed = Q._feed(spark, MID).join(Q._config(spark, MID).select("user_id", "diversity_ratio"), "user_id").toPandas()
    engaged = {(r.user_id, r.category_slug) for r in H.engaged_categories(Q._feed_profile(spark, MID)).collect()}
    routes = H.cold_start(Q.fx.users(spark, MID), Q.fx.interactions(spark, MID), Q.fx.preferences(spark, MID), n=Q.COLD)
    assert {r.route for r in routes.select("route").distinct().collect()} == {"model", "preferences"}
    assert feed.diversity.any() and set(feed.user_id) == {r.user_id for r in routes.collect()}
    for (user, relaxed), own in feed.groupby(["user_id", "cap_relaxed"]):
        assert sorted(own.position) == list(range(1, len(own) + 1)) and len(own) <= 20
        assert all(((user, c) in engaged) != d for c, d in zip(own.category_slug, own.diversity))
        assert own.diversity.sum() <= round(20 * own.diversity_ratio.iloc[0])
        assert relaxed or own.category_slug.value_counts().iloc[0] <= len(own) / 2


def test_undominated_items_hold_every_top(spark):
    """Whatever a user's weights are, the best k of a category are among the items that are kept."""
    rng = np.random.default_rng(3)
    items = [(i, "a" if i % 2 else "b", float(rng.choice([1.2, 1.0, *rng.uniform(0, 1, 40)]))) for i in range(500)]
    speed = [(i, float(rng.integers(1, 6))) for i in range(0, 500, 7)]
    kept = {r.article_id for r in H.undominated(spark.createDataFrame(items, "article_id long, category_slug string, recency double"),
                                                spark.createDataFrame(speed, "item_id long, velocity double"), 5).collect()}
    v = dict(speed)
    assert len(kept) < 250
    for content, weight in ((0, 0), (0, 1), (1, 0), (.5, .3), (.01, 2)):
        for category in "ab":
            best = sorted((-(content + weight * v.get(i, 0)) * rec, i) for i, c, rec in items if c == category)[:5]
            assert {i for _, i in best} <= kept


def test_tiles_ship_and_link_less_than_pairs(spark):
    """Whatever tiles are, pairs are those of brute force; a cell's links are fewer than its rows, not its pairs."""
    rng = np.random.default_rng(7)
    rows = rows_of(rng, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(S.near_dup_pairs(df, None, 0.3, 48, rows_per_block=8, blocks_per_tile=2)) == brute(rows, rows, 0.3, 48, True)
    want = brute(rows, rows, -0.5, 48, True)
    assert S.near_dup_links(df, -0.5, 48).count() < 3 * len(rows) < len(want)


def test_forest_keeps_components():
    rng = np.random.default_rng(2)
    for n, m in ((50, 30), (50, 400), (1000, 700)):
        x, y = rng.integers(0, n, m) * 7, rng.integers(0, n, m) * 7
        a, b = S._forest(x, y)
        parent = {int(v): int(v) for v in (*x, *y)}

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for i, j in zip(map(int, x), map(int, y)):
            lo, hi = sorted((find(i), find(j)))
            parent[hi] = lo
        assert {(int(i), int(j)) for i, j in zip(a, b)} == {(find(v), v) for v in parent if find(v) != v}
