"""Domain views derived from the driver tables (see FIXTURES.md §3).

These only reshape the driver tables into the schemas the operators expect
(articles, interactions, users, ...). They do none of the operators' work.
The SQL texts are the fixed view definitions from FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.tables import read_table

AS_OF = "2024-01-31 00:00:00"

# The 19 category slugs in display order.
CATEGORY_SLUGS = (
    "national", "international", "politics", "business", "finance", "sports", "technology",
    "science", "automobile", "education", "health", "entertainment", "lifestyle", "crime",
    "environment", "jobs", "defence", "real_estate", "opinion",
)

_CATS = "array(" + ",".join(f"'{c}'" for c in CATEGORY_SLUGS) + ")"

_ARTICLES = f"""
SELECT doc_id AS article_id, split_part(text, '\\n', 1) AS title, text AS content,
  lang AS language, source AS source_name,
  element_at({_CATS}, CAST(doc_id % 19 + 1 AS INT)) AS category_slug,
  timestampadd(MINUTE, CAST(-((doc_id * 7919) % 43200) AS INT), TIMESTAMP_NTZ'{AS_OF}') AS publish_time
FROM {{documents}}
"""

_INTERACTIONS = """
SELECT event_id, ts, user_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS item_id,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'like' WHEN 'signup' THEN 'bookmark'
    WHEN 'purchase' THEN 'share' ELSE 'comment' END AS interaction_type,
  CASE WHEN event_type = 'view' THEN value END AS time_spent_seconds
FROM {events}
"""

_USERS = """
SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'es' ELSE 'fr' END AS language
FROM (SELECT DISTINCT user_id FROM {events}) u
"""

_PREFERENCES = f"""
SELECT user_id, language AS preferred_languages,
  concat_ws(',', element_at(c, CAST(user_id % 19 + 1 AS INT)), element_at(c, CAST((user_id + 5) % 19 + 1 AS INT)),
            element_at(c, CAST((user_id + 11) % 19 + 1 AS INT))) AS preferred_categories,
  user_id % 5 <> 0 AS notification_enabled
FROM (SELECT user_id, language, {_CATS} AS c FROM {{users}} WHERE user_id % 7 <> 0) u
"""

_SOURCES = """
SELECT DISTINCT source AS source_name, 1 + CAST(substring(source, 4) AS INT) % 3 AS priority,
  CAST(5 + CAST(substring(source, 4) AS INT) % 6 AS DOUBLE) / CAST(10 AS DOUBLE) AS reliability_score
FROM {documents}
"""

_SCRAPE_LOG = """
SELECT event_id AS seq, ts, concat('src', user_id % 20) AS source_name,
  CASE WHEN event_type IN ('error', 'signup') OR (event_type = 'view' AND user_id % 2 = 0)
       THEN 'error' ELSE 'success' END AS status
FROM {events}
"""

_COMMENTS = """
SELECT conv_id * 100 + turn AS comment_id, conv_id AS item_id,
  CASE WHEN turn = 0 THEN NULL ELSE conv_id * 100 + turn - 1 END AS parent_id, role AS user_role, text AS content
FROM {conversations}
"""


def _view(spark: SparkSession, sf_dir: str, sql: str, needs: tuple[str, ...]) -> DataFrame:
    # DataFrames bind as SQL parameters: no global temp views are touched.
    frames = {name: users(spark, sf_dir) if name == "users" else read_table(spark, sf_dir, name)
              for name in needs}
    return spark.sql(sql, **frames)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _ARTICLES, ("documents",))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _INTERACTIONS, ("events",))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _USERS, ("events",))


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _PREFERENCES, ("events", "users"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _SOURCES, ("documents",))


def scrape_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _SCRAPE_LOG, ("events",))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _COMMENTS, ("conversations",))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article vectors: embeddings.vec_id is the article id."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("article_id"), F.col("embedding"))


def categories(spark: SparkSession) -> DataFrame:
    """The fixed 19-row category dimension (slug, display_order)."""
    return spark.createDataFrame([(s, i + 1) for i, s in enumerate(CATEGORY_SLUGS)],
                                 "category_slug string, display_order int")


def as_of_lit():
    return F.lit(AS_OF).cast("timestamp_ntz")


def interaction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """interactions plus an ``action`` column: the n-th like of a (user, item) pair
    is 'like' for odd n and 'unlike' for even n (FIXTURES.md §3); other types
    keep their type as the action."""
    from pyspark.sql import Window as W
    ev = interactions(spark, sf_dir)
    w = W.partitionBy("user_id", "item_id", "interaction_type").orderBy("ts", "event_id")
    nth = F.row_number().over(w)
    return ev.withColumn(
        "action",
        F.when(F.col("interaction_type") == "like",
               F.when(nth % 2 == 1, F.lit("like")).otherwise(F.lit("unlike")))
        .otherwise(F.col("interaction_type")))
