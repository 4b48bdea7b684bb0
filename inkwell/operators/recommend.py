"""Recommendation (H2-H19): decayed category profiles, content scores, ALS,
hybrid blend, recency, diversity-capped feeds, A/B assignment and metrics.

Every per-user ranking is a window partitioned by user (never global), and every
top-k is ``row_number() <= k`` so Spark pre-limits per map task
(WindowGroupLimit). Aggregates are algebraic and pre-aggregated map-side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import md5_bucket
from inkwell.functions.time import age_seconds_exact, ts_lit
from inkwell.session import BROADCAST_ROWS, cut_lineage, sized_broadcast

HALF_LIFE_DAYS = 3.0
# Hybrid weights (spec).
HYBRID_WEIGHTS = {"content": 0.40, "collaborative": 0.35, "trending": 0.25}
ENGAGED_TYPES = ("like", "bookmark", "comment", "share")
N_CATEGORIES = 19


def _decay(age_s, half_life_days: float) -> F.Column:
    return F.pow(F.lit(0.5), age_s / F.lit(86400.0 * half_life_days))


def user_profile_vector(signals: DataFrame, items: DataFrame, as_of, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """H2: per (user, category) Σ weight · 0.5^(age_days / half_life) over signals
    up to as_of. ``signals``: user_id, item_id, ts, weight; ``items``: article_id,
    category_slug."""
    s = signals.where(F.col("ts") <= ts_lit(as_of))
    it = items.select(F.col("article_id").alias("item_id"), "category_slug")
    j = s.join(it, "item_id")
    return j.groupBy("user_id", "category_slug").agg(
        F.sum(F.col("weight") * _decay(age_seconds_exact(F.col("ts"), as_of), half_life)).alias("affinity"))


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` over all shuffle partitions: few rows that a join makes many, which AQE would coalesce."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def category_scores(profile: DataFrame) -> DataFrame:
    """(user_id, category_slug, content_score): affinity over the profile's length."""
    n = profile.groupBy("user_id").agg(F.sqrt(F.sum(F.col("affinity") * F.col("affinity"))).alias("_norm"))
    return profile.join(n, "user_id").select("user_id", "category_slug",
                                             (F.col("affinity") / F.col("_norm")).alias("content_score"))


def content_scores(profile: DataFrame, candidates: DataFrame, digits: int | None = None) -> DataFrame:
    """H3: cosine between the user's category vector and a candidate's one-hot
    category vector = affinity[category] / ||profile||. Sparse: only categories
    the user has touched produce rows. Users are dealt over all tasks and candidates are sent to them: a join by the
    few categories would put a category's pairs in one task. With ``digits`` scores are rounded, once a user and category."""
    c = candidates.select("article_id", "category_slug")
    scores = category_scores(profile)
    if digits is not None:
        scores = scores.withColumn("content_score", F.round("content_score", digits))
    return _spread(scores, "user_id").join(sized_broadcast(c), "category_slug").select(
        "user_id", "article_id", "category_slug", "content_score")


def first_of_category(candidates: DataFrame, n: int) -> DataFrame:
    """The ``n`` candidates of each category with the smallest ids. All candidates of a category have one content score for a
    user, so a user's ``n`` best by (content score, id) are among these, whatever the profile is."""
    w = Window.partitionBy("category_slug").orderBy("article_id")
    return candidates.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def category_affinity(events: DataFrame, items: DataFrame) -> DataFrame:
    """H4 (R12): distinct items liked, bookmarked, commented or shared ÷ distinct
    items read, per user and category; null when nothing was read."""
    it = items.select(F.col("article_id").alias("item_id"), "category_slug")
    e = events.join(it, "item_id")
    engaged = F.when(F.col("action").isin(*ENGAGED_TYPES), F.col("item_id"))
    read = F.when(F.col("interaction_type") == "read", F.col("item_id"))
    agg = e.groupBy("user_id", "category_slug").agg(
        F.count_distinct(engaged).alias("engaged_items"), F.count_distinct(read).alias("read_items"))
    return agg.withColumn("affinity", F.when(F.col("read_items") > 0,
                                             F.col("engaged_items") / F.col("read_items")))


def cold_start(users: DataFrame, events: DataFrame, prefs: DataFrame, n: int = 20) -> DataFrame:
    """H5: users with fewer than ``n`` interactions take the preference path,
    the rest the model path."""
    cnt = events.groupBy("user_id").agg(F.count("*").alias("interactions"))
    j = (users.select("user_id").join(cnt, "user_id", "left")
         .join(prefs.select("user_id", F.lit(True).alias("has_preferences")), "user_id", "left"))
    k = F.coalesce(F.col("interactions"), F.lit(0))
    return j.select("user_id", k.cast("bigint").alias("interactions"),
                    F.coalesce("has_preferences", F.lit(False)).alias("has_preferences"),
                    F.when(k < n, F.lit("preferences")).otherwise(F.lit("model")).alias("route"))


def update_profile(stored: DataFrame, stored_as_of, new_profile: DataFrame, as_of,
                   half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """H6: decay the stored vector from its as_of to the new as_of and add the
    new batch's (already decayed to as_of) contributions."""
    from datetime import datetime
    dt = (datetime.fromisoformat(str(as_of)) - datetime.fromisoformat(str(stored_as_of))).total_seconds()
    factor = 0.5 ** (dt / (86400.0 * half_life))
    s = stored.select("user_id", "category_slug", (F.col("affinity") * F.lit(factor)).alias("_old"))
    n = new_profile.select("user_id", "category_slug", F.col("affinity").alias("_new"))
    return (s.join(n, ["user_id", "category_slug"], "full_outer")
            .select("user_id", "category_slug",
                    (F.coalesce("_old", F.lit(0.0)) + F.coalesce("_new", F.lit(0.0))).alias("affinity")))


def train_als(matrix: DataFrame, rank: int = 10, max_iter: int = 10, reg: float = 0.1, alpha: float = 1.0,
              seed: int = 42):
    """H7: implicit-feedback ALS on the engagement matrix (user_id, item_id, engagement).

    Ids must be integers that fit an int (a persisted, only-growing id map in
    production); the fixtures' ids already are.
    """
    from pyspark.ml.recommendation import ALS
    als = ALS(userCol="user_id", itemCol="item_id", ratingCol="engagement", implicitPrefs=True, rank=rank,
              maxIter=max_iter, regParam=reg, alpha=alpha, seed=seed, coldStartStrategy="drop",
              nonnegative=False)
    data = matrix.select(F.col("user_id").cast("int").alias("user_id"), F.col("item_id").cast("int").alias("item_id"),
                         F.col("engagement").cast("float").alias("engagement"))
    return als.fit(data)


_TOP = "user_id long, item_id long, cf_score double"
_TOP_ARROW = pa.schema([("user_id", pa.int64()), ("item_id", pa.int64()), ("cf_score", pa.float64())])


def _best_of_cell(n: int):
    """The ``n`` best unseen items of a block for each user of a block, by one product of matrices."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        people, seen = left.filter(pc.is_null(left["item_id"])), left.filter(pc.is_valid(left["item_id"]))
        if not people.num_rows or not right.num_rows:
            return _TOP_ARROW.empty_table()
        users, items = people["user_id"].to_numpy(), right["item_id"].to_numpy()
        order = np.argsort(items)
        items = items[order]
        u, v = (np.stack(t["v"].to_numpy()) for t in (people, right))
        score = u.astype(np.float64) @ v[order].astype(np.float64).T
        if seen.num_rows:
            by_user = np.argsort(users)
            i = by_user[np.searchsorted(users[by_user], seen["user_id"].to_numpy())]
            score[i, np.searchsorted(items, seen["item_id"].to_numpy())] = -np.inf
        m = min(n, len(items))
        # Of equal scores the smaller id is the better: a stable sort of ascending ids.
        at = np.argsort(-score, axis=1, kind="stable")[:, :m]
        top = np.take_along_axis(score, at, axis=1)
        good = top > -np.inf
        return pa.table([np.repeat(users, m)[good.ravel()], items[at][good], top[good]], schema=_TOP_ARROW)

    return best


def top_products(users: DataFrame, items: DataFrame, seen: DataFrame, n: int, rows: int = 2048) -> DataFrame:
    """Exact top ``n`` inner products per user with seen items left out: user_id, item_id, cf_score, rank.

    ``users`` (user_id, v), ``items`` (item_id, v), ``seen`` (user_id, item_id). Items lie in blocks by descending norm.
    All users meet the first block; of the others a block of users meets only those in which a product of norms
    exceeds some user's n-th best so far. Seen pairs come to the cell of their user and item as rows, so no list of
    what a user has seen is ever held, and no user's number of them matters to others. Ties: smaller item id.
    """
    def norm(c: str):
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))

    parts = [max(1, -(-d.count() // rows)) for d in (users, items)]
    u = cut_lineage(users.select(F.col("user_id").cast("long").alias("user_id"), "v", norm("v").alias("size"),
                                 F.pmod(F.xxhash64("user_id"), F.lit(parts[0])).alias("ub")))
    i = items.select(F.col("item_id").cast("long").alias("item_id"), "v", norm("v").alias("size"))
    i = i.repartitionByRange(parts[1], F.col("size").desc(), "item_id") if parts[1] > 1 else i.coalesce(1)
    i = cut_lineage(i.withColumn("ib", F.spark_partition_id()))
    pairs = seen.select(F.col("user_id").cast("long").alias("user_id"), F.col("item_id").cast("long").alias("item_id")).distinct()
    pairs = pairs.join(u.select("user_id", "ub"), "user_id").join(i.select("item_id", "ib"), "item_id")
    blocks = i.groupBy("ib").agg(F.max("size").alias("most"))
    first = blocks.agg(F.min("ib")).first()[0]
    rank = Window.partitionBy("user_id").orderBy(F.col("cf_score").desc(), "item_id")

    def meet(cells: DataFrame) -> DataFrame:
        """``cells``: ub, ib."""
        c = cells.select(F.col("ub").alias("_u"), F.col("ib").alias("_i"))
        people = u.join(F.broadcast(c) if parts[0] * parts[1] <= BROADCAST_ROWS else c, F.col("ub") == F.col("_u")).select(
            "ub", F.col("_i").alias("ib"), "user_id", F.lit(None).cast("long").alias("item_id"), "v")
        known = pairs.join(cells, ["ub", "ib"], "left_semi").select("ub", "ib", "user_id", "item_id", F.lit(None).cast(u.schema["v"].dataType).alias("v"))
        there = i.select("item_id", "v", F.col("ib").alias("ib")).join(c, F.col("ib") == F.col("_i")).select(
            F.col("_u").alias("ub"), "ib", "item_id", "v")
        left = people.unionByName(known).groupBy("ub", "ib")
        return left.cogroup(there.groupBy("ub", "ib")).applyInArrow(_best_of_cell(n), _TOP)

    if first is None:
        return u.sparkSession.createDataFrame([], _TOP + ", rank int")
    every = u.select("ub").distinct()
    found = cut_lineage(meet(every.withColumn("ib", F.lit(first))))
    nth = found.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") == n).select("user_id", F.col("cf_score").alias("least"))
    # A user with fewer than n so far may still take anything.
    need = u.join(nth, "user_id", "left").select("ub", "size", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    others = blocks.where(F.col("ib") != first)
    open_cells = need.groupBy("ub").agg(F.max(F.when(F.col("least") < 0, float("inf")).when(F.col("size") > 0, F.lit(0.0) - F.col("least") / F.col("size"))
                                              .otherwise(float("inf"))).alias("_least"))
    # size * most >= least for some user of the block, that is most >= the smallest of least / size.
    cells = open_cells.join(others, F.col("most") >= -F.col("_least") - 1e-9).select("ub", "ib")
    rest = meet(cut_lineage(cells)) if parts[1] > 1 else found.limit(0)
    return found.unionByName(rest).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def als_recommend(model, users: DataFrame, seen: DataFrame, n: int = 10) -> DataFrame:
    """H8: top-n ALS items per user with seen items removed, by ``top_products`` over the model's factors."""
    people = model.userFactors.select(F.col("id").cast("long").alias("user_id"), F.col("features").alias("v")).join(
        users.select(F.col("user_id").cast("long").alias("user_id")).distinct(), "user_id", "left_semi")
    items = model.itemFactors.select(F.col("id").cast("long").alias("item_id"), F.col("features").alias("v"))
    return top_products(people, items, seen, n)


def _per_user_max_scale(df: DataFrame, col: str) -> F.Column:
    m = F.max(F.greatest(F.col(col), F.lit(0.0))).over(Window.partitionBy("user_id"))
    return F.when(m > 0, F.greatest(F.col(col), F.lit(0.0)) / m).otherwise(F.lit(0.0))


def hybrid_score(content: DataFrame | None, cf: DataFrame | None, trending: DataFrame | None,
                 weights: dict | None = None, config: DataFrame | None = None, offered: DataFrame | None = None) -> DataFrame:
    """H9 (R7): blend = w_c·content + w_cf·collaborative + w_t·trending.

    Content and ALS scores are scaled by the user's max (negatives → 0), trending by its global max (a scalar
    subquery); a missing score counts 0. ``content``: user_id, article_id, content_score; ``cf``: user_id, item_id,
    cf_score; ``trending``: item_id, velocity (per item). The three are joined full outer: ``offered`` (user_id, article_id)
    says which trending items are candidates of a user beyond those that content and collaborative scores name.
    ``config`` (user_id, w_content, w_collaborative, w_trending) sets a user's own weights (H14).
    """
    parts = []
    if content is not None:
        parts.append(content.select("user_id", "article_id",
                                    _per_user_max_scale(content, "content_score").alias("c")))
    if cf is not None:
        parts.append(cf.select("user_id", F.col("item_id").cast("bigint").alias("article_id"),
                               _per_user_max_scale(cf, "cf_score").alias("cf")))
    if offered is not None:
        parts.append(offered.select("user_id", "article_id").distinct())
    base = parts[0]
    for p in parts[1:]:
        base = base.join(p, ["user_id", "article_id"], "full_outer")
    for col in ("c", "cf"):
        if col not in base.columns:
            base = base.withColumn(col, F.lit(0.0))
    return _blend(base, trending, weights, config)


def hybrid_over_categories(profile: DataFrame, candidates: DataFrame, cf: DataFrame, trending: DataFrame, offered: DataFrame,
                           digits: int | None = None) -> DataFrame:
    """H9 over the content scores of ``profile`` and ``candidates`` (H3), without shuffling a pair of user and candidate.

    Gives what ``hybrid_score(content_scores(profile, candidates), cf, trending, offered=offered)`` does. A user's greatest
    content score is that of a category, and what the user has beyond content, a few dozen items of ``cf`` (one row a user
    and item) and ``offered``, travels with the user's categories, so pairs are made and scored in one task. With ``digits``
    all four numbers are rounded: those of pairs with a content score alone once a user and category, as rounding takes longer
    than all else that is done for a pair.
    """
    c = candidates.select("article_id", "category_slug")
    scores = _spread(category_scores(profile), "user_id").join(F.broadcast(c.select("category_slug").distinct()), "category_slug", "left_semi")
    p = scores.select("user_id", "category_slug", _per_user_max_scale(scores, "content_score").alias("c"))
    rounded = []
    if digits is not None:
        alone = sum(F.lit(HYBRID_WEIGHTS[k]) * x for k, x in (("content", F.col("c")), ("collaborative", F.lit(0.0)), ("trending", F.lit(0.0))))
        p, rounded = p.withColumns({"_c": F.round("c", digits), "_alone": F.round(alone, digits)}), ["_c", "_alone"]
    own = cf.select("user_id", F.col("item_id").cast("bigint").alias("article_id"), _per_user_max_scale(cf, "cf_score").alias("cf"))
    own = own.join(offered.select("user_id", "article_id").distinct(), ["user_id", "article_id"], "full_outer")
    own = cut_lineage(own)
    known = own.where("article_id IS NOT NULL AND cf IS NOT NULL").groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("article_id", "cf"))).alias("_cf"))
    pairs = p.join(_spread(known, "user_id"), "user_id", "left").join(sized_broadcast(c), "category_slug").select(
        "user_id", "article_id", "c", F.col("_cf")[F.col("article_id")].alias("cf"), *rounded)
    met = own.join(c, "article_id").join(p.select("user_id", "category_slug"), ["user_id", "category_slug"]).select("user_id", "article_id")
    rest = own.join(met, ["user_id", "article_id"], "left_anti").select("user_id", "article_id", F.lit(None).cast("double").alias("c"), "cf")
    return _blend(pairs.unionByName(rest, allowMissingColumns=True), trending, digits=digits)


def _blend(base: DataFrame, trending: DataFrame | None, weights: dict | None = None, config: DataFrame | None = None,
           digits: int | None = None) -> DataFrame:
    """Scaled parts ``c`` and ``cf`` of (user_id, article_id) with those of trending, weighted. With ``digits`` all are rounded, and
    ``base`` has ``_c`` and ``_alone``, the content part and the score of it alone, rounded."""
    w = dict(HYBRID_WEIGHTS, **(weights or {}))
    if trending is not None:
        tmax = trending.agg(F.max("velocity")).scalar()  # scalar subquery
        t = trending.select(F.col("item_id").alias("article_id"),
                            F.when(tmax > 0, F.col("velocity") / tmax).otherwise(F.lit(0.0)).alias("t"))
        if digits is not None:
            t = t.withColumn("_t", F.round("t", digits))
        base = base.join(sized_broadcast(t), "article_id", "left")
    else:
        base = base.withColumn("t", F.lit(0.0))
    names = {"w_content": "content", "w_collaborative": "collaborative", "w_trending": "trending"}
    if config is not None:
        base = base.join(config.select("user_id", *names), "user_id", "left")
        wc, wcf, wt = (F.coalesce(F.col(c), F.lit(w[k])) for c, k in names.items())
    else:
        wc, wcf, wt = (F.lit(w[k]) for k in names.values())
    c, cf, t = (F.coalesce(F.col(x), F.lit(0.0)) for x in ("c", "cf", "t"))
    score = wc * c + wcf * cf + wt * t
    if digits is not None:
        no_cf, no_t = F.col("cf").isNull(), F.col("t").isNull()
        score = F.when(no_cf & no_t, F.coalesce("_alone", F.lit(0.0))).otherwise(F.round(score, digits))
        c, cf, t = F.coalesce("_c", F.lit(0.0)), F.when(no_cf, F.lit(0.0)).otherwise(F.round(cf, digits)), F.coalesce("_t", F.lit(0.0))
    return base.select("user_id", "article_id", c.alias("content_part"), cf.alias("cf_part"), t.alias("trending_part"),
                       score.alias("hybrid_score"))


def undominated(items: DataFrame, velocity: DataFrame, k: int) -> DataFrame:
    """Of each category the items that can be among the ``k`` best of anyone without a collaborative score for them.

    ``items``: article_id, category_slug, recency. All items of a category have one content score for a user, so an
    item with k others of no less velocity and recency (and a smaller id, where both are equal) is never among the
    best k. Kept are the k most recent of each velocity, and the k smallest ids of it for scores that are all zero: a few
    times k a category, whatever the number of articles. Spark limits the groups before it shuffles. ``_recent`` and ``_least``
    say which of the two an item is kept as.
    """
    v = velocity.select(F.col("item_id").alias("article_id"), "velocity")
    j = items.join(v, "article_id", "left").withColumn("velocity", F.coalesce("velocity", F.lit(0.0)))
    group = Window.partitionBy("category_slug", "velocity")

    def best(recent: bool, *order) -> DataFrame:
        first = j.withColumn("_r", F.row_number().over(group.orderBy(*order))).where(F.col("_r") <= k).drop("_r")
        return first.withColumns({"_recent": F.lit(recent), "_least": F.lit(not recent)})

    both = best(True, F.col("recency").desc(), "article_id").union(best(False, "article_id"))
    return both.groupBy("article_id", "category_slug", "recency", "velocity").agg(F.max("_recent").alias("_recent"), F.max("_least").alias("_least"))


def feed_profile(profile: DataFrame, routes: DataFrame, prefs: DataFrame) -> DataFrame:
    """(user_id, category_slug, affinity) that a feed goes by (H5): the decayed profile of users on the model's route, and
    the preferred categories, alike, of those on the preferences' route."""
    model = profile.join(routes.where("route = 'model'").select("user_id"), "user_id", "left_semi")
    cold = routes.where("route = 'preferences'").select("user_id").join(
        prefs.select("user_id", F.explode(F.split("preferred_categories", ",")).alias("category_slug")), "user_id")
    return model.select("user_id", "category_slug", "affinity").unionByName(
        cold.select("user_id", F.trim("category_slug").alias("category_slug"), F.lit(1.0).alias("affinity")))


def feed_scores(users: DataFrame, profile: DataFrame, items: DataFrame, velocity: DataFrame, cf: DataFrame, categories: list[str],
                k: int, config: DataFrame | None = None) -> DataFrame:
    """Scored candidates (user_id, article_id, category_slug, score) of every user, in all ``categories``.

    A user meets the undominated items of every category, touched or not, and the items of ``cf`` (user_id, item_id,
    cf_score); nothing else can be among the k best of a category. ``items``: article_id, category_slug, recency.
    score = hybrid (H9, with a user's own weights) times recency.
    """
    kinds = undominated(items, velocity, k)
    tmax = velocity.agg(F.max("velocity")).scalar()  # scalar subquery
    attrs = items.join(velocity.select(F.col("item_id").alias("article_id"), "velocity"), "article_id", "left").select(
        "article_id", "category_slug", "recency", F.when((F.col("velocity") > 0) & (tmax > 0), F.col("velocity") / tmax).otherwise(F.lit(0.0)).alias("t"))
    entry = F.struct("article_id", "recency", "t", F.lit(None).cast("double").alias("cf"))
    # Few rows a category. Content scores that tell recencies apart need the most recent items alone, those of zero without velocity
    # the smallest ids.
    some = kinds.join(attrs, ["article_id", "category_slug", "recency"])
    lists = some.groupBy("category_slug").agg(F.collect_list(F.when(F.col("_recent"), entry)).alias("_apart"), F.collect_list(entry).alias("_all"),
                                              F.collect_list(F.when(F.col("_least") | (F.col("velocity") > 0), entry)).alias("_zero"))
    lists = cut_lineage(lists)
    norm = profile.groupBy("user_id").agg(F.sqrt(F.sum(F.col("affinity") * F.col("affinity"))).alias("_norm"))
    p = profile.join(norm, "user_id").select("user_id", "category_slug", (F.col("affinity") / F.col("_norm")).alias("content_score"))
    every = users.where("user_id IS NOT NULL").select("user_id", F.explode(F.array(*map(F.lit, categories))).alias("category_slug"))
    content_of = every.join(p, ["user_id", "category_slug"], "left").withColumn("content_score", F.coalesce("content_score", F.lit(0.0)))
    content_of = _spread(content_of.join(F.broadcast(lists.select("category_slug")), "category_slug", "left_semi"), "user_id")
    own = cf.select("user_id", F.col("item_id").cast("bigint").alias("article_id"), "cf_score").join(attrs, "article_id").join(
        users.select("user_id"), "user_id", "left_semi")
    own = own.withColumn("cf", _per_user_max_scale(own, "cf_score")).groupBy("user_id").agg(
        F.collect_list(F.struct("article_id", "recency", "t", "cf", "category_slug")).alias("_own"))
    names = {"w_content": "content", "w_collaborative": "collaborative", "w_trending": "trending"}
    u = content_of.select("user_id", "category_slug", _per_user_max_scale(content_of, "content_score").alias("c")).join(own, "user_id", "left")
    if config is not None:
        u = u.join(config.select("user_id", *names), "user_id", "left")
    wc, wcf, wt = (F.coalesce(F.col(c), F.lit(HYBRID_WEIGHTS[x])) if config is not None else F.lit(HYBRID_WEIGHTS[x]) for c, x in names.items())
    of_list = F.when(wc * F.col("c") >= 0.01, F.col("_apart")).when((wc * F.col("c") == 0), F.col("_zero")).otherwise(F.col("_all"))
    mine = F.transform(F.filter("_own", lambda x: x["category_slug"] == F.col("category_slug")),
                       lambda x: F.struct(x["article_id"].alias("article_id"), x["recency"].alias("recency"), x["t"].alias("t"), x["cf"].alias("cf")))
    # Users are dealt once, with their categories and own items; the pairs are made, and later ranked, where a user is.
    pairs = u.join(F.broadcast(lists), "category_slug").select(
        "user_id", "category_slug", "c", wc.alias("_wc"), wcf.alias("_wcf"), wt.alias("_wt"), F.transform("_own", lambda x: x["article_id"]).alias("_ids"),
        F.explode(F.concat(of_list, F.coalesce(mine, F.array().cast("array<struct<article_id:bigint,recency:double,t:double,cf:double>>")))).alias("_x"))
    pairs = pairs.where(F.col("_x.cf").isNotNull() | F.col("_ids").isNull() | ~F.array_contains("_ids", F.col("_x.article_id")))
    hybrid = F.col("_wc") * F.col("c") + F.col("_wcf") * F.coalesce(F.col("_x.cf"), F.lit(0.0)) + F.col("_wt") * F.col("_x.t")
    return pairs.select("user_id", F.col("_x.article_id").alias("article_id"), "category_slug",
                        F.round(hybrid * F.col("_x.recency"), 9).alias("score"))


def recency_factor(ts, as_of) -> F.Column:
    """H10 (R8): 1.2 up to 4 h old, 1.0 up to 24 h, then 0.5^((age_h - 24) / 24)."""
    age_h = age_seconds_exact(ts, as_of) / F.lit(3600.0)
    return (F.when(age_h <= 4, F.lit(1.2)).when(age_h <= 24, F.lit(1.0))
            .otherwise(F.pow(F.lit(0.5), (age_h - 24) / F.lit(24.0))))


def diverse_feed(scored: DataFrame, engaged: DataFrame, k: int = 20, ratio: float = 0.2,
                 cap: float = 0.5, config: DataFrame | None = None) -> DataFrame:
    """H11 (R9): per user a feed of at most k items where about ``ratio`` of the
    slots go to categories the user has not engaged with and no category exceeds
    ``cap`` of the returned feed.

    scored: user_id, article_id, category_slug, score; engaged: user_id, category_slug; ``config`` (user_id,
    diversity_ratio) sets a user's own ratio (H14), in whole percents.
    Main pool = engaged-category items with rank-in-category <= floor(cap·k), top
    (1-ratio)·k by score; diversity pool = top ratio·k of the other categories.
    The largest category of the union keeps its best min(m, floor(rest·cap/(1-cap)))
    items; with one category only, floor(cap·k) items flagged ``cap_relaxed``.
    The j-th diversity item takes slot ceil(j / ratio), every fifth at 20 %; main items fill the others.
    """
    per_cat = int(math.floor(cap * k))
    # By user alone, so that scores dealt by user are not shuffled again; a user has no more entries than there are categories.
    eng = engaged.groupBy("user_id").agg(F.collect_set("category_slug").alias("_eng"))
    s = scored.join(eng, "user_id", "left").withColumn("_div", ~F.coalesce(F.array_contains("_eng", F.col("category_slug")), F.lit(False)))
    own = F.lit(None).cast("double")
    if config is not None:
        s = s.join(config.select("user_id", "diversity_ratio"), "user_id", "left")
        own = F.col("diversity_ratio")
    s = s.withColumn("_pct", F.round(F.coalesce(own, F.lit(ratio)) * 100).cast("int"))
    n_div = F.round(F.col("_pct") * k / 100).cast("int")
    by_score = [F.col("score").desc(), F.col("article_id")]
    # A ranking's bound is a constant for Spark's limit before the shuffle; a user's own share is taken after it.
    first = (s.withColumn("_rc", F.row_number().over(Window.partitionBy("user_id", "category_slug").orderBy(*by_score)))
             .where(F.col("_rc") <= k).where(F.col("_div") | (F.col("_rc") <= per_cat)))
    u = (first.withColumn("_r", F.row_number().over(Window.partitionBy("user_id", "_div").orderBy(*by_score)))
         .where(F.col("_r") <= k).where(F.col("_r") <= F.when(F.col("_div"), n_div).otherwise(k - n_div)))
    u = u.select("user_id", "article_id", "category_slug", "score", F.col("_div").alias("diversity"), "_pct")
    # Category sizes inside the union; the largest category (ties: smallest slug).
    wc = Window.partitionBy("user_id", "category_slug")
    wu = Window.partitionBy("user_id")
    u = (u.withColumn("_cat_n", F.count("*").over(wc))
         .withColumn("_tot", F.count("*").over(wu))
         .withColumn("_cat_rank", F.row_number().over(wc.orderBy(*by_score)))
         .withColumn("_big", F.min(F.struct((-F.col("_cat_n")).alias("n"), F.col("category_slug").alias("slug"))).over(wu)))
    rest = F.col("_tot") + F.col("_big.n")
    allowed = F.least(-F.col("_big.n"), F.floor(rest * F.lit(cap) / F.lit(1.0 - cap)))
    relaxed = rest == 0
    keep = (F.when(relaxed, F.col("_cat_rank") <= per_cat)
            .when(F.col("category_slug") == F.col("_big.slug"), F.col("_cat_rank") <= allowed)
            .otherwise(F.lit(True)))
    kept = u.withColumn("cap_relaxed", relaxed).where(keep)
    kept = kept.withColumn("_rr", F.row_number().over(Window.partitionBy("user_id", "diversity").orderBy(*by_score)))
    slot = F.expr("CASE WHEN diversity THEN (_rr * 100 + _pct - 1) div _pct ELSE _rr + (_rr - 1) * _pct div (100 - _pct) END")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("_slot", F.col("diversity").desc()))
    return kept.withColumn("_slot", slot).select("user_id", "article_id", "category_slug", "score", "diversity", "cap_relaxed",
                                                 pos.alias("position"))


def feed_skew(feed: DataFrame, cap: float = 0.5) -> DataFrame:
    """Category share of each user's feed and a skew flag (share > cap)."""
    c = feed.groupBy("user_id", "category_slug").agg(F.count("*").alias("items"))
    share = F.col("items") / F.sum("items").over(Window.partitionBy("user_id"))
    return c.withColumn("share", share).withColumn("skewed", F.col("share") > cap)


def ab_assign(users: DataFrame, experiments: list[tuple[str, str, int]]) -> DataFrame:
    """Stable bucket 0-99 from md5('experiment:user'); variants own
    consecutive bucket ranges by cumulative share, in the listed order.

    ``experiments``: [(experiment, variant, share_percent), ...] (configuration).
    """
    by_exp: dict[str, list[tuple[str, int]]] = {}
    for exp, var, share in experiments:
        by_exp.setdefault(exp, []).append((var, share))
    exp_col = F.explode(F.array(*[F.lit(e) for e in by_exp])).alias("experiment")
    u = users.select("user_id", exp_col)
    u = u.withColumn("bucket", md5_bucket(F.concat(F.col("experiment"), F.lit(":"), F.col("user_id").cast("string")), 100))
    variant = None
    for exp, vs in by_exp.items():
        hi = 0
        for var, share in vs:
            hi += share
            cond = (F.col("experiment") == exp) & (F.col("bucket") < hi)
            variant = F.when(cond, F.lit(var)) if variant is None else variant.when(cond, F.lit(var))
    return u.select("user_id", "experiment", variant.alias("variant"), "bucket")


def with_config(assign: DataFrame, variants: DataFrame) -> DataFrame:
    """Attach per-variant config (weights, diversity ratio) to each user."""
    return assign.join(F.broadcast(variants), ["experiment", "variant"], "left")


def ab_metrics(assign: DataFrame, events: DataFrame, items: DataFrame) -> DataFrame:
    """Per variant: CTR (engagements per read), average read time and
    diversity = Shannon entropy of read categories / ln 19 (R10)."""
    it = items.select(F.col("article_id").alias("item_id"), "category_slug")
    e = events.join(assign.select("user_id", "experiment", "variant"), "user_id")
    base = e.groupBy("experiment", "variant").agg(
        F.count_if(F.col("interaction_type") == "read").alias("reads"),
        F.count_if(F.col("action").isin(*ENGAGED_TYPES)).alias("engagements"),
        F.avg(F.when(F.col("interaction_type") == "read", F.col("time_spent_seconds"))).alias("avg_time_spent"))
    cats = (e.where(F.col("interaction_type") == "read").join(it, "item_id")
            .groupBy("experiment", "variant", "category_slug").agg(F.count("*").alias("n")))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("experiment", "variant"))
    ent = (cats.withColumn("_p", p).groupBy("experiment", "variant")
           .agg((-F.sum(F.col("_p") * F.log(F.col("_p"))) / F.lit(math.log(N_CATEGORIES))).alias("diversity")))
    return (base.join(ent, ["experiment", "variant"], "left")
            .withColumn("ctr", F.when(F.col("reads") > 0, F.col("engagements") / F.col("reads"))))


def rank_auc(scores: DataFrame, positives: DataFrame) -> DataFrame:
    """Per-user AUC of liked items above the others by rank sum, ties
    averaged: (Σ ranks of positives − P(P+1)/2) / (P·N)."""
    s = scores.join(positives.select("user_id", "article_id", F.lit(1).alias("_pos")), ["user_id", "article_id"], "left")
    wt = Window.partitionBy("user_id", "score")
    r = (s.withColumn("_r", F.rank().over(Window.partitionBy("user_id").orderBy("score")))
         .withColumn("_ties", F.count("*").over(wt))
         .withColumn("_avg_rank", F.col("_r") + (F.col("_ties") - 1) / 2.0))
    agg = r.groupBy("user_id").agg(
        F.sum(F.when(F.col("_pos") == 1, F.col("_avg_rank"))).alias("_rs"),
        F.count_if(F.col("_pos") == 1).alias("positives"),
        F.count_if(F.col("_pos").isNull()).alias("negatives"))
    p, n = F.col("positives"), F.col("negatives")
    return agg.select("user_id", "positives", "negatives",
                      F.when((p > 0) & (n > 0), (F.col("_rs") - p * (p + 1) / 2.0) / (p * n)).alias("auc"))


def stale_feeds(events: DataFrame, feeds: DataFrame, articles: DataFrame, users: DataFrame) -> DataFrame:
    """Users whose feed must be rebuilt: a like/share/comment since the feed
    was built, or a new article in their language since then.
    feeds: user_id, built_at."""
    ev = (events.where(F.col("action").isin("like", "share", "comment"))
          .join(feeds, "user_id").where(F.col("ts") > F.col("built_at"))
          .select("user_id").distinct().withColumn("reason", F.lit("interaction")))
    newest = articles.groupBy("language").agg(F.max("publish_time").alias("_newest"))
    fl = feeds.join(users.select("user_id", "language"), "user_id")
    na = (fl.join(newest, "language").where(F.col("_newest") > F.col("built_at"))
          .select("user_id").withColumn("reason", F.lit("new_articles")))
    return ev.unionByName(na).groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def list_overlap(a: DataFrame, b: DataFrame, n: int = 10) -> DataFrame:
    """Jaccard of two top-n lists per user (a, b: user_id, article_id, rank)."""
    ta = a.where(F.col("rank") <= n).select("user_id", "article_id", F.lit(1).alias("_a"))
    tb = b.where(F.col("rank") <= n).select("user_id", "article_id", F.lit(1).alias("_b"))
    j = ta.join(tb, ["user_id", "article_id"], "full_outer")
    agg = j.groupBy("user_id").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("inter"),
                                   F.count("*").alias("union"))
    return agg.withColumn("jaccard", F.col("inter") / F.col("union"))


def engaged_categories(profile: DataFrame) -> DataFrame:
    """A user's engaged set: every category with affinity (H2, or preferences by ``feed_profile``)."""
    return profile.where(F.col("affinity") > 0).select("user_id", "category_slug")
