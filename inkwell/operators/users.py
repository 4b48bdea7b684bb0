"""Users and preferences (F1-F5), comment threads (F8) and bookmarks (F11):
request-at-a-time service code re-expressed as set-based merges over a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_CATEGORIES = 3
MIN_LANGUAGES = 1


def resolve_users(logins: DataFrame, users: DataFrame) -> DataFrame:
    """match each login by google_id, else link an existing user by email
    (its google_id becomes the latest login's), else create a 'reader'.
    last_login_at = latest login.

    logins: login_ts, google_id, email, display_name; users: user_id, email,
    google_id, role, last_login_at. Within a batch the latest login per google_id
    wins (arrival order). New logins that share an email create one user, with the
    latest one's google_id. New users get id = max(user_id) + rank.
    Returns the full users table after the batch.
    """
    w = Window.partitionBy("google_id").orderBy(F.col("login_ts").desc(), F.col("email"))
    lg = logins.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    by_gid = lg.join(users.select("user_id", F.col("google_id").alias("_ug")), lg.google_id == F.col("_ug"), "left")
    matched = by_gid.where(F.col("user_id").isNotNull()).select("user_id", "login_ts", F.col("google_id").alias("_link"))
    rest = by_gid.where(F.col("user_id").isNull()).drop("user_id", "_ug")
    by_mail = rest.join(users.select("user_id", F.col("email").alias("_ue")), rest.email == F.col("_ue"), "left")
    linked = by_mail.where(F.col("user_id").isNotNull()).select("user_id", "login_ts", F.col("google_id").alias("_link"))
    fresh = by_mail.where(F.col("user_id").isNull()).drop("user_id", "_ue")
    wm = Window.partitionBy(F.coalesce("email", "google_id")).orderBy(F.col("login_ts").desc(), F.col("google_id").desc())
    fresh = fresh.withColumn("_r", F.row_number().over(wm)).where("_r = 1")
    max_id = users.agg(F.max("user_id")).scalar()
    wn = Window.orderBy("login_ts", "google_id")  # over new users of one batch only
    created = fresh.select((F.coalesce(max_id, F.lit(0)) + F.row_number().over(wn)).cast("bigint").alias("user_id"),
                           "email", "google_id", F.lit("reader").alias("role"), F.col("login_ts").alias("last_login_at"))
    upd = matched.unionByName(linked).groupBy("user_id").agg(
        F.max("login_ts").alias("_login"), F.max_by("_link", F.struct("login_ts", "_link")).alias("_link"))
    old = (users.join(upd, "user_id", "left")
           .select("user_id", "email", F.coalesce("_link", "google_id").alias("google_id"), "role",
                   F.greatest("last_login_at", "_login").alias("last_login_at")))
    return old.unionByName(created)


def _csv(arr):
    return F.array_join(arr, ",")


def _split_csv(c):
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def apply_onboarding(requests: DataFrame, prefs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (user_id, categories ARRAY, languages ARRAY, ts) need >= 3
    categories and >= 1 language; valid ones upsert the preference row (CSV).
    Returns (preferences after, rejected requests)."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc())
    r = requests.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    ok = (F.size(F.array_distinct("categories")) >= MIN_CATEGORIES) & (F.size("languages") >= MIN_LANGUAGES)
    good = r.where(ok)
    bad = r.where(~ok).withColumn("reason", F.when(F.size(F.array_distinct("categories")) < MIN_CATEGORIES,
                                                   F.lit("too_few_categories")).otherwise(F.lit("no_language")))
    g = good.select("user_id", _csv("categories").alias("_cats"), _csv("languages").alias("_langs"))
    j = prefs.join(g, "user_id", "full_outer")
    out = j.select("user_id", F.coalesce("_langs", "preferred_languages").alias("preferred_languages"),
                   F.coalesce("_cats", "preferred_categories").alias("preferred_categories"),
                   F.coalesce("notification_enabled", F.lit(True)).alias("notification_enabled"))
    return out, bad


def apply_patches(requests: DataFrame, prefs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """patches (user_id, ts, categories ARRAY?, languages ARRAY?, notification_enabled?):
    only non-null fields change (latest non-null per field wins); a patch with
    fewer than 3 categories is rejected whole; an empty language list is accepted."""
    bad_rows = requests.where(F.col("categories").isNotNull() & (F.size("categories") < MIN_CATEGORIES))
    good = requests.join(bad_rows.select("user_id", "ts"), ["user_id", "ts"], "left_anti")

    def newest(value, given):
        return F.max_by(value, F.when(F.col(given).isNotNull(), F.col("ts")))

    # The latest value that is given, field by field: a user's patches meet as one row a map task.
    last = good.groupBy("user_id").agg(
        newest(_csv("categories"), "categories").alias("_cats"), newest(_csv("languages"), "languages").alias("_langs"),
        newest("notification_enabled", "notification_enabled").alias("_notif"))
    j = prefs.join(last, "user_id", "full_outer")
    out = j.select("user_id", F.coalesce("_langs", "preferred_languages", F.lit("en")).alias("preferred_languages"),
                   F.coalesce("_cats", "preferred_categories").alias("preferred_categories"),
                   F.coalesce("_notif", "notification_enabled", F.lit(True)).alias("notification_enabled"))
    return out, bad_rows.withColumn("reason", F.lit("too_few_categories"))


def user_profile(users: DataFrame, prefs: DataFrame) -> DataFrame:
    """profile view; needs_onboarding = no preference row."""
    p = prefs.select("user_id", "preferred_languages", "preferred_categories", "notification_enabled",
                     F.lit(True).alias("_has"))
    j = users.join(p, "user_id", "left")
    return j.withColumn("needs_onboarding", F.col("_has").isNull()).drop("_has")


def explode_prefs(prefs: DataFrame) -> DataFrame:
    """(user_id, kind, value) rows from the CSV preference columns."""
    cats = prefs.select("user_id", F.lit("category").alias("kind"),
                        F.explode(_split_csv(F.col("preferred_categories"))).alias("value"))
    langs = prefs.select("user_id", F.lit("language").alias("kind"),
                         F.explode(_split_csv(F.col("preferred_languages"))).alias("value"))
    return cats.unionByName(langs).distinct()


def comment_rejects(comments: DataFrame) -> DataFrame:
    """F8: comments that no root leads to, because a parent is missing or parent links form a cycle."""
    return comments.join(comment_threads(comments).select("comment_id"), "comment_id", "left_anti")


def comment_threads(comments: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """F8: comment forest: root, depth, path and direct reply count per comment;
    deleting a comment drops its whole subtree.

    By pointer doubling: each comment knows an ancestor and the path up to it, and takes over that ancestor's own
    pointer and path in every round, so a thread of depth d needs about log2(d) rounds, each a join that is
    checkpointed. A round that brings no comment to its root is the last: what is left hangs from a cycle.
    comments: comment_id, item_id, parent_id.
    Comments that hang from a missing parent or a cycle are in no thread: see comment_rejects.
    """
    from inkwell.session import cut_lineage
    own = F.col("comment_id").cast("string")
    known = comments.select(F.col("comment_id").alias("up"), F.lit(True).alias("_there"))
    c = comments.select("comment_id", "item_id", "parent_id", F.col("parent_id").alias("up"),
                        F.when(F.col("parent_id").isNotNull(), 1).otherwise(0).alias("depth"), own.alias("path"))
    # A parent that is missing is no pointer; its comments are in no thread.
    c = c.join(known, "up", "left").where(F.col("up").isNull() | F.col("_there")).drop("_there")
    c = cut_lineage(c.withColumn("root_id", F.when(F.col("up").isNull(), F.col("comment_id"))))
    waiting = c.where("up IS NOT NULL").count()
    while waiting:
        t = c.select(F.col("comment_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("path").alias("_p"),
                     F.col("root_id").alias("_root"), F.lit(True).alias("_there"))
        moving = c.where("up IS NOT NULL").join(t, "up", "left").where("_there")  # an ancestor that fell away takes these along
        moved = moving.select(F.col("comment_id"), "item_id", "parent_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"),
                              F.concat("_p", F.lit("/"), "path").alias("path"), F.col("_root").alias("root_id"))
        c = cut_lineage(c.where("up IS NULL").select(*moved.columns).unionByName(moved))
        left = c.where("up IS NOT NULL").count()
        if left == waiting:
            break
        waiting = left
    out = c.where("up IS NULL").select("comment_id", "item_id", "parent_id", "root_id", "depth", "path")
    if deleted is not None:
        gone = deleted.select(F.col(deleted.columns[0]).alias("_del"))
        # A comment is gone when any id on its path (itself or an ancestor) is deleted.
        anc = out.select("comment_id", F.explode(F.transform(F.split("path", "/"), lambda x: x.cast("bigint"))).alias("_anc"))
        hit = anc.join(gone, anc._anc == gone._del, "left_semi").select("comment_id").distinct()
        out = out.join(hit, "comment_id", "left_anti")
    replies = out.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("comment_id")).agg(
        F.count("*").alias("reply_count"))
    return (out.join(replies, "comment_id", "left")
            .withColumn("reply_count", F.coalesce("reply_count", F.lit(0)).cast("bigint")))


def bookmarks(state: DataFrame, items: DataFrame, n: int | None = None) -> DataFrame:
    """active bookmarks per user, newest first (optionally the first n)."""
    b = state.where((F.col("kind") == "bookmark") & F.col("active")).select("user_id", "item_id", "last_ts")
    j = b.join(items.select(F.col("article_id").alias("item_id"), "title"), "item_id")
    w = Window.partitionBy("user_id").orderBy(F.col("last_ts").desc(), F.col("item_id"))
    j = j.withColumn("position", F.row_number().over(w))
    return j.where(F.col("position") <= n) if n else j
