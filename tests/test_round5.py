"""Findings of round 4: what vectors, feeds and categories shuffle, write and compute."""

import re

import numpy as np
import pytest

from inkwell.operators import categories as C
from inkwell.operators import recommend as H
from inkwell.operators import similarity as S
from inkwell.plans import q_stories


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_texts_of_a_large_model_are_not_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "b c"), (3, "c d e"), (4, ""), (None, "a b")], "article_id long, content string")
    model = S.cut_lineage(S.fit_embedder(docs))
    monkeypatch.setattr(S, "BROADCAST_ROWS", 2)
    assert "REPARTITION_BY_NUM" not in plan_of(S.embed(docs, model))


def test_links_write_vectors_once(spark, monkeypatch):
    """The vectors of links and of their blocks are written once, whatever else is; their copies are still linked."""
    rng = np.random.default_rng(5)
    rows = [(i, f"2024-01-{1 + i % 9:02d} 00:00:00", rng.normal(size=8).tolist()) for i in range(40)]
    rows += [(100 + i, t, v) for i, t, v in rows[:5]] + [(200, rows[0][1], [0.0] * 8), (201, None, rows[0][2])]
    df = spark.createDataFrame(rows, "article_id long, t string, embedding array<double>").selectExpr(
        "article_id", "cast(t AS timestamp_ntz) publish_time", "embedding")
    wide = []

    def cut(frame, kept=S.cut_lineage):
        if "u" in frame.columns:
            wide.append(frame.columns)
        return kept(frame)

    monkeypatch.setattr(S, "cut_lineage", cut)
    links = S.near_dup_links(df, 0.999, 48, rows_per_block=4, blocks_per_tile=2).collect()
    assert {(r.id_a, r.id_b) for r in links} == {(i, 100 + i) for i in range(5)}
    assert len(wide) == 1


@pytest.mark.parametrize("zero", [False, True])
def test_a_summary_bounds_its_block(spark, zero):
    rng = np.random.default_rng(1)
    u = rng.normal(size=(30, 6))
    u /= np.linalg.norm(u, axis=1)[:, None]
    if zero:
        u[1::2] = -u[::2]
    rows = [(i, i, 10 + i, 0, 0 if zero else i % 3, 5, u[i].tolist()) for i in range(30)]
    points = spark.createDataFrame(rows, "id long, lo long, hi long, b long, blk long, tile int, u array<double>").repartition(4)
    for r in S._summaries(points).collect():
        own = [x for x in rows if x[4] == r.blk]
        assert (r.lo, r.hi, r.tile) == (min(x[1] for x in own), max(x[2] for x in own), 5)
        c = np.array(r.centre)
        assert abs(np.linalg.norm(c) - 1) < 1e-9
        assert r.radius == pytest.approx(max(np.arccos(np.clip(np.array([x[6] for x in own]) @ c, -1, 1))))


def test_members_are_written_once(spark, tmp_path):
    docs = [(i, f"title {i}\nbody of text {i % 4}", "en", f"src{i % 3}") for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>").where("vec_id > 1").write.parquet(f"{tmp_path}/embeddings.parquet")
    m = q_stories._members(spark, str(tmp_path))
    assert sorted(r.article_id for r in m.collect()) == list(range(12))
    assert "Join" not in plan_of(m)


def feed_inputs(spark):
    rng = np.random.default_rng(4)
    items = [(i, "ab"[i % 2], round(float(rng.uniform(0.1, 1)), 3)) for i in range(60)]
    speed = [(i, float(rng.integers(1, 4))) for i in range(0, 60, 7)]
    cf = [(u, int(i), float(rng.integers(-1, 9))) for u in (1, 2) for i in rng.choice(60, 6, replace=False)]
    profile = [(1, "a", 2.0), (1, "b", 1.0), (2, "a", 1.0)]
    config = [(1, 0.4, 0.35, 0.25), (2, 0.0, 0.3, 0.4), (3, 0.4, 0.35, 0.25)]
    frames = (spark.createDataFrame([(1,), (2,), (3,), (None,)], "user_id long"),
              spark.createDataFrame(profile, "user_id long, category_slug string, affinity double"),
              spark.createDataFrame(items, "article_id long, category_slug string, recency double"),
              spark.createDataFrame(speed, "item_id long, velocity double"),
              spark.createDataFrame(cf, "user_id long, item_id long, cf_score double"),
              spark.createDataFrame(config, "user_id long, w_content double, w_collaborative double, w_trending double"))
    return (items, dict(speed), cf, profile, config), frames


def test_feed_scores_hold_every_best(spark):
    (items, speed, cf, profile, config), (users, prof, it, vel, scores, conf) = feed_inputs(spark)
    k = 4
    got = {}
    for r in H.feed_scores(users, prof, it, vel, scores, ["a", "b", "none"], k, conf).collect():
        assert (r.user_id, r.article_id) not in got
        got[r.user_id, r.article_id] = (r.category_slug, r.score)
    most = {u: max(s for v, _, s in cf if v == u) for u in (1, 2)}
    liked = {(u, i): max(s, 0) / most[u] for u, i, s in cf}
    for u, wc, wcf, wt in config:
        own = {c: a for v, c, a in profile if v == u}
        top = max(own.values(), default=1)
        for category in "ab":
            want = sorted((-round((wc * own.get(category, 0) / top + wcf * liked.get((u, i), 0) + wt * speed.get(i, 0) / max(speed.values())) * rec, 9), i)
                          for i, c, rec in items if c == category)[:k]
            best = sorted((-s, i) for (v, i), (c, s) in got.items() if v == u and c == category)[:k]
            assert [i for _, i in best] == [i for _, i in want]
            assert [s for s, _ in best] == pytest.approx([s for s, _ in want])


def test_pairs_of_a_feed_are_not_shuffled(spark):
    _, (users, prof, it, vel, scores, conf) = feed_inputs(spark)
    feed = H.diverse_feed(H.feed_scores(users, prof, it, vel, scores, ["a", "b"], 4, conf), prof.select("user_id", "category_slug"), 4)
    lines = plan_of(feed).splitlines()
    made = next(i for i, x in enumerate(lines) if "Generate explode(concat" in x)
    depth = [len(re.match(r"[\s:|+*-]*", x)[0]) for x in lines]
    above = [x for i, x in enumerate(lines[:made]) if depth[i] < min(depth[i + 1:made + 1], default=99)]
    assert above and not any("Exchange" in x for x in above)


def test_words_of_a_page_are_taken_once(spark):
    pages = spark.createDataFrame([(1, "s", "https://x.de/a", "cricket ai ai"), (2, "s", None, None)], "page_id long, source_key string, url string, content string")
    rules = spark.createDataFrame([("s", "/b", "health")], "source_key string, prefix string, category_slug string")
    out = C.assign_category(pages, rules, spark.createDataFrame([("s", "jobs")], "source_key string, category_slug string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(lower(") == 1
    assert sorted((r.page_id, r.category_slug, r.category_by) for r in out.collect()) == [(1, "sports", "keyword"), (2, "jobs", "default")]
