"""Steps that shuffled pairs of users and candidates, or read texts several times."""

from pyspark.sql import functions as F

from inkwell.operators import recommend as H


def test_hybrid_over_categories_equals_the_joined_pairs(spark):
    profile = spark.createDataFrame([(u, c, float((u * 7 + i * 3) % 5 - 1)) for u in range(6) for i, c in enumerate("abz")],
                                    "user_id long, category_slug string, affinity double")
    items = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(12)] + [(None, "a"), (3, "a")], "article_id long, category_slug string")
    cf = spark.createDataFrame([(u, i, float(u + i) / 5 - 0.4) for u in range(1, 7) for i in (u, u + 1, 99)], "user_id long, item_id long, cf_score double")
    speed = spark.createDataFrame([(0, 0.5), (3, 2.0), (77, 1.0)], "item_id long, velocity double")
    offered = spark.createDataFrame([(u, i) for u in range(8) for i in (0, 3, 77)], "user_id long, article_id long")

    def rows(df):
        return sorted((str(r.user_id), str(r.article_id), *(round(x, 9) for x in r[2:])) for r in df.collect())

    want = rows(H.hybrid_score(H.content_scores(profile, items), cf, speed, offered=offered))
    assert rows(H.hybrid_over_categories(profile, items, cf, speed, offered)) == want and len(want) > 40


def test_the_first_of_a_category_hold_every_users_best(spark):
    profile = spark.createDataFrame([(u, c, 1.0 + (u * i) % 3) for u in range(5) for i, c in enumerate("abc")],
                                    "user_id long, category_slug string, affinity double")
    items = spark.createDataFrame([((i * 37) % 101, "abc"[i % 3]) for i in range(100)], "article_id long, category_slug string")

    def best(candidates):
        out = {}
        for r in H.content_scores(profile, candidates).collect():
            out.setdefault(r.user_id, []).append((-r.content_score, r.article_id))
        return {u: sorted(v)[:4] for u, v in out.items()}

    few = H.first_of_category(items, 4)
    assert few.count() == 12 and best(few) == best(items)


def test_content_pairs_need_no_shuffle_by_category(spark):
    profile = spark.range(50).select(F.col("id").alias("user_id"), F.lit("a").alias("category_slug"), F.lit(1.0).alias("affinity"))
    items = spark.range(30).select(F.col("id").alias("article_id"), F.lit("a").alias("category_slug"))
    scores = H.content_scores(profile, items)
    assert scores.count() == 1500 and "hashpartitioning(category_slug" not in scores._jdf.queryExecution().toString()
