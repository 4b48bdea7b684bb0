"""Source registry operators (A1-A15): config scan, validation, merge, filters,
health, failure runs, seeding, crawl plan, robots filter and config updates.

Everything is set-based: the per-process dictionaries and counters of a web
service become DataFrames keyed by the source key, and sequential state
updates become aggregates that give the same final state (SURVEY R1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.text import host_of, md5_bucket, source_key, strip_ws
from inkwell.functions.time import ts_lit

# Allowed enums and config defaults.
SCRAPE_TYPES = ("playwright", "rss", "static")
LANGUAGES = ("en", "hi", "ta", "te", "kn")
DEFAULTS = {"language": "en", "category_slug": "national", "priority": 1,
            "rate_limit_seconds": 2.0, "is_active": True}
SELECTOR_FIELDS = ("article_list_url", "article_link_selector", "title_selector", "body_selector",
                   "image_selector", "date_selector", "author_selector")

CONFIG_SCHEMA = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("base_url", T.StringType()),
     T.StructField("scrape_type", T.StringType()), T.StructField("language", T.StringType()),
     T.StructField("category_slug", T.StringType()), T.StructField("priority", T.LongType()),
     T.StructField("rate_limit_seconds", T.DoubleType()), T.StructField("is_active", T.BooleanType()),
     T.StructField("feed_url", T.StringType())]
    + [T.StructField(f, T.StringType()) for f in SELECTOR_FIELDS]
    + [T.StructField("category_mapping", T.MapType(T.StringType(), T.StringType())),
       T.StructField("custom_headers", T.MapType(T.StringType(), T.StringType())),
       T.StructField("_corrupt_record", T.StringType())])

def _empty_map():
    return F.create_map().cast("map<string,string>")


def load_source_configs(spark: SparkSession, path: str) -> DataFrame:
    """A1: one JSON object per file; defaults filled; file name kept for ordering."""
    raw = (spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record")
           .json(path).select("*", F.col("_metadata.file_name").alias("file_name")))
    return raw.select(
        "name", "base_url", "scrape_type",
        *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in DEFAULTS.items()],
        "feed_url", *SELECTOR_FIELDS,
        F.coalesce("category_mapping", _empty_map()).alias("category_mapping"),
        F.coalesce("custom_headers", _empty_map()).alias("custom_headers"),
        "_corrupt_record", "file_name")


def _reject_reason() -> F.Column:
    missing = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    return F.concat_ws(
        ";",
        F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed_json")),
        F.when(F.col("_corrupt_record").isNull() & missing("name"), F.lit("missing_name")),
        F.when(F.col("_corrupt_record").isNull() & missing("base_url"), F.lit("missing_base_url")),
        F.when(F.col("_corrupt_record").isNull() & missing("scrape_type"), F.lit("missing_scrape_type")),
        F.when(F.col("scrape_type").isNotNull() & ~F.col("scrape_type").isin(*SCRAPE_TYPES),
               F.lit("bad_scrape_type")))


def validate_sources(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A2: split configs into (valid, rejects); a bad file never stops the rest."""
    tagged = df.withColumn("reject_reason", _reject_reason())
    valid = tagged.where(F.col("reject_reason") == "").drop("reject_reason", "_corrupt_record")
    rejects = tagged.where(F.col("reject_reason") != "").select("file_name", "name", "reject_reason")
    return valid, rejects


def merge_sources(json_df: DataFrame, db_df: DataFrame) -> DataFrame:
    """A4: JSON beats DB; among JSON the last file (by name) wins per key; among DB
    rows the first (by ``db_seq``) wins. DB rows carry ``url`` as base_url, get
    priority 1, default rate and no selectors or maps."""
    j = json_df.select(
        source_key("name").alias("source_key"), "name", "base_url", "scrape_type", "language",
        "category_slug", F.col("priority").cast("bigint").alias("priority"), "rate_limit_seconds",
        "is_active", "feed_url", *SELECTOR_FIELDS, "category_mapping", "custom_headers",
        F.lit(0).alias("_origin"), F.col("file_name").alias("_order_s"), F.lit(None).cast("bigint").alias("_order_n"))
    d = db_df.select(
        source_key("name").alias("source_key"), "name", F.col("url").alias("base_url"), "scrape_type",
        F.coalesce("language", F.lit(DEFAULTS["language"])).alias("language"),
        F.coalesce("category_slug", F.lit(DEFAULTS["category_slug"])).alias("category_slug"),
        F.lit(1).cast("bigint").alias("priority"), F.lit(DEFAULTS["rate_limit_seconds"]).alias("rate_limit_seconds"),
        F.coalesce("is_active", F.lit(True)).alias("is_active"), "feed_url",
        *[F.lit(None).cast("string").alias(f) for f in SELECTOR_FIELDS],
        _empty_map().alias("category_mapping"), _empty_map().alias("custom_headers"),
        F.lit(1).alias("_origin"), F.lit(None).cast("string").alias("_order_s"), F.col("db_seq").alias("_order_n"))
    w = Window.partitionBy("source_key").orderBy(
        F.col("_origin"), F.col("_order_s").desc_nulls_last(), F.col("_order_n").asc_nulls_last())
    return (j.unionByName(d).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .drop("_rn", "_origin", "_order_s", "_order_n"))


def filter_sources(df: DataFrame, language: str | None = None, scrape_type: str | None = None,
                   active_only: bool = False, name: str | None = None, combine: bool = False) -> DataFrame:
    """A5: list filters. By default one filter applies, with precedence
    name > active > language > type (language and type imply active);
    ``combine=True`` ANDs every given filter instead."""
    key = source_key("name")
    if combine:
        cond = F.lit(True)
        if name is not None:
            cond = cond & (key == source_key(F.lit(name)))
        if active_only or language is not None or scrape_type is not None:
            cond = cond & F.col("is_active")
        if language is not None:
            cond = cond & (F.col("language") == language)
        if scrape_type is not None:
            cond = cond & (F.col("scrape_type") == scrape_type)
        return df.where(cond)
    if name is not None:
        return df.where(key == source_key(F.lit(name)))
    if active_only:
        return df.where(F.col("is_active"))
    if language is not None:
        return df.where((F.col("language") == language) & F.col("is_active"))
    if scrape_type is not None:
        return df.where((F.col("scrape_type") == scrape_type) & F.col("is_active"))
    return df


def health_counts(log: DataFrame) -> DataFrame:
    """Per ``source_key`` of a scrape log: counts of successes and errors, the last event and the last error. Counts
    add up and events are compared, so two such tables merge into that of both logs."""
    err = F.col("status") == "error"
    message = F.col("error") if "error" in log.columns else F.lit(None).cast("string")
    event = F.struct("ts", "seq", "status")
    return log.groupBy("source_key").agg(
        F.count_if(F.col("status") == "success").alias("success_count"), F.count_if(err).alias("error_count"),
        F.max(event).alias("last_event"), F.max(F.when(err, F.struct("ts", "seq", message.alias("error")))).alias("last_error_event"))


def health_view(counts: DataFrame) -> DataFrame:
    """Health by ``health_counts``: success rate (1.0 with no scrapes), and healthy where the last event is a success
    or the rate is 0.5 or more."""
    total = F.col("success_count") + F.col("error_count")
    rate = F.when(total == 0, F.lit(1.0)).otherwise(F.col("success_count") / total)
    return counts.select(
        "source_key", F.col("success_count").cast("bigint").alias("success_count"),
        F.col("error_count").cast("bigint").alias("error_count"), F.col("last_event.ts").alias("last_scrape_time"),
        F.col("last_error_event.ts").alias("last_error_time"), F.col("last_error_event.error").alias("last_error"),
        rate.alias("success_rate"),
        ((F.col("last_event.status") == "success") | (rate >= 0.5) | (total == 0)).alias("is_healthy"))


def source_health(scrape_log: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source success/error counts, last scrape time, last error, success
    rate (1.0 with no scrapes) and is_healthy = last event ok OR rate >= 0.5 OR no
    events. Log rows of unknown sources are dropped (left_semi on the key)."""
    log = scrape_log.withColumn("source_key", source_key("source_name"))
    known = sources.select(source_key("source_name").alias("source_key"))
    return health_view(health_counts(log.join(known, "source_key", "left_semi")))


def sources_with_health(src: DataFrame, health: DataFrame) -> DataFrame:
    """Every source with a nested health struct; no health → 0, 0, 1.0, healthy."""
    s = src.withColumn("source_key", source_key("source_name"))
    j = s.join(health, "source_key", "left")
    h = F.struct(
        F.coalesce("success_count", F.lit(0)).cast("bigint").alias("success_count"),
        F.coalesce("error_count", F.lit(0)).cast("bigint").alias("error_count"),
        F.col("last_scrape_time"), F.col("last_error"),
        F.coalesce("success_rate", F.lit(1.0)).alias("success_rate"),
        F.coalesce("is_healthy", F.lit(True)).alias("is_healthy"))
    return j.select(*src.columns, "source_key", h.alias("health"))


def failure_runs(log: DataFrame, as_of, n: int = 5, cooldown_minutes: float = 30) -> DataFrame:
    """Consecutive failures after the last success per source; unhealthy at
    ``n``; eligible for retry ``cooldown`` after the last failure.

    Two algebraic aggregates instead of a window over each source's whole log: a hot
    source never lands in one task; the per-source side of the join has one row per
    source (AQE broadcasts it at runtime when small).
    """
    lg = log.where(F.col("ts") <= ts_lit(as_of)).select("source_name", "ts", "seq", "status")
    last_ok = lg.groupBy("source_name").agg(
        F.max(F.when(F.col("status") == "success", F.struct("ts", "seq"))).alias("last_ok"))
    j = lg.join(last_ok, "source_name")
    after = F.col("last_ok").isNull() | (F.struct("ts", "seq") > F.col("last_ok"))
    agg = j.groupBy("source_name").agg(
        F.count_if((F.col("status") == "error") & after).alias("consecutive_failures"),
        F.max(F.when(F.col("status") == "error", F.col("ts"))).alias("last_failure"))
    retry_at = F.col("last_failure") + F.expr(f"INTERVAL {int(cooldown_minutes * 60)} SECONDS")
    unhealthy = F.col("consecutive_failures") >= n
    return agg.select(
        "source_name", F.col("consecutive_failures").cast("bigint").alias("consecutive_failures"),
        "last_failure", unhealthy.alias("unhealthy"),
        F.when(unhealthy, retry_at).alias("retry_at"),
        (unhealthy & (retry_at <= ts_lit(as_of))).alias("retry_eligible"))


def seed_dim(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Idempotent seed: insert only rows whose key is missing."""
    missing = rows.join(existing.select(key), key, "left_anti")
    return existing.unionByName(missing, allowMissingColumns=True)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A10: raw pages as (url, html, fetched_at) from parquet, JSON or binary files."""
    if fmt == "binaryFile":
        from inkwell.operators.parse import repair_encoding
        df = spark.read.format("binaryFile").load(path)
        return df.select(F.col("path").alias("url"), repair_encoding("content").alias("html"),
                         F.col("modificationTime").cast("timestamp_ntz").alias("fetched_at"))
    df = spark.read.format(fmt).load(path)
    fetched = F.col("fetched_at") if "fetched_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    keep = [c for c in df.columns if c not in ("url", "html", "fetched_at")]
    return df.select(*keep, "url", "html", fetched.alias("fetched_at"))


def crawl_plan(sources: DataFrame, urls: DataFrame, window_s: int = 600) -> DataFrame:
    """Spread active sources over the crawl window and space requests to the
    same host by the source's rate limit.

    sources: source_name, rate_limit_seconds, is_active; urls: source_name, url.
    A source's start offset is a stable md5 slot in the window (millisecond grid),
    so sources spread evenly without a global ranking; requests to one host then
    follow at ``rate_limit_seconds`` spacing in URL order.
    """
    act = sources.where(F.col("is_active")).select(
        "source_name", "rate_limit_seconds",
        (md5_bucket("source_name", window_s * 1000) / F.lit(1000.0)).alias("source_offset_s"))
    u = urls.select("source_name", "url", host_of("url").alias("host")).distinct()
    j = u.join(act, "source_name")
    wh = Window.partitionBy("host").orderBy("url")
    return (j.withColumn("position", F.row_number().over(wh))
            .withColumn("delay_s", F.col("rate_limit_seconds") * (F.col("position") - 1))
            .withColumn("scheduled_offset_s", F.col("source_offset_s") + F.col("delay_s"))
            .select("source_name", "host", "url", "position", "source_offset_s", "delay_s", "scheduled_offset_s"))


def robots_filter(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop URLs whose path starts with a disallowed prefix for their host
    (rule host '*' applies to every host).

    Instead of a theta join, each URL's path expands to its character prefixes
    (bounded by URL length) and meets the rules on an equi-join (host, prefix).
    """
    u = urls.withColumn("_host", host_of("url")).withColumn(
        "_path", F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1))
    u = u.withColumn("_path", F.when(F.col("_path") == "", F.lit("/")).otherwise(F.col("_path")))
    r = rules.select(F.lower(F.col("host")).alias("_rhost"), F.col("prefix").alias("_prefix")).distinct()
    pref = (u.select("url", "_host", F.explode(F.sequence(F.lit(1), F.length("_path"))).alias("_len"),
                     "_path")
            .select("url", "_host", F.substring(F.col("_path"), F.lit(1), F.col("_len")).alias("_prefix")))
    exact = pref.join(r, (pref._host == r._rhost) & (pref._prefix == r._prefix)).select("url")
    wild = pref.join(r.where(F.col("_rhost") == "*").select("_prefix"), "_prefix").select("url")
    blocked = exact.unionByName(wild).distinct()
    return u.join(blocked, "url", "left_anti").drop("_host", "_path")


def update_sources(existing: DataFrame, changes: DataFrame, key: str = "source_name",
                   order_col: str = "changed_at") -> DataFrame:
    """Apply a batch of changes: the latest change per key wins, null fields
    keep the old value; new keys are inserted."""
    fields = [c for c in changes.columns if c not in (key, order_col)]
    latest = changes.groupBy(key).agg(
        *[F.max_by(F.col(c), F.col(order_col)).alias(c) for c in fields])
    e = existing.alias("e")
    c = latest.alias("c")
    j = e.join(c, F.col(f"e.{key}") == F.col(f"c.{key}"), "full_outer")
    cols = [F.coalesce(F.col(f"e.{key}"), F.col(f"c.{key}")).alias(key)]
    for col in existing.columns:
        if col == key:
            continue
        if col in fields:
            cols.append(F.coalesce(F.col(f"c.{col}"), F.col(f"e.{col}")).alias(col))
        else:
            cols.append(F.col(f"e.{col}"))
    return j.select(*cols)


__all__ = ["load_source_configs", "validate_sources", "merge_sources", "filter_sources", "source_health",
           "sources_with_health", "failure_runs", "seed_dim", "read_pages", "crawl_plan", "robots_filter",
           "update_sources", "strip_ws"]
