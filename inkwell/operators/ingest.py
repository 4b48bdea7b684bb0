"""Ingest operators: feed parsing (A11), article upsert (A12), feed body (B12),
scraper union (B13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import canonical_url

RSS_SCHEMA = ("channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, "
              "pubDate: STRING, guid: STRING, author: STRING, `content:encoded`: STRING, "
              "category: ARRAY<STRING>>>>")
ATOM_SCHEMA = ("entry ARRAY<STRUCT<title: STRING, id: STRING, updated: STRING, published: STRING, "
               "summary: STRING, content: STRING, author: STRUCT<name: STRING>, "
               "link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>>>")


def parse_feeds(feeds: DataFrame, xml_col: str = "xml", source_col: str = "source_name") -> DataFrame:
    """RSS 2.0 items and Atom entries, one row each, in one schema.

    ``from_xml`` runs inside the JVM per row; the two formats are told apart by
    their root element and unified by ``coalesce``.
    """
    x = F.col(xml_col)
    is_atom = F.lower(x).rlike(r"^\s*(<\?xml[^>]*>\s*)?<feed[\s>]")
    rss = F.from_xml(x, RSS_SCHEMA)
    atom = F.from_xml(x, ATOM_SCHEMA)
    base = feeds.select(F.col(source_col).alias("source_name"), is_atom.alias("_atom"), rss.alias("_rss"),
                        atom.alias("_a"))
    r = (base.where(~F.col("_atom"))
         .select("source_name", F.explode_outer("_rss.channel.item").alias("i"))
         .where(F.col("i").isNotNull())
         .select("source_name", F.lit("rss").alias("feed_format"),
                 F.col("i.title").alias("title"), F.trim(F.col("i.link")).alias("url"),
                 F.coalesce(F.col("i.guid"), F.col("i.link")).alias("guid"),
                 F.col("i.description").alias("summary"), F.col("i.`content:encoded`").alias("content"),
                 F.col("i.author").alias("author"), F.col("i.pubDate").alias("published_raw")))
    a = (base.where(F.col("_atom"))
         .select("source_name", F.explode_outer("_a.entry").alias("e"))
         .where(F.col("e").isNotNull())
         .select("source_name", F.lit("atom").alias("feed_format"),
                 F.col("e.title").alias("title"),
                 F.coalesce(F.filter("e.link", lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
                            .getItem(0)["_href"], F.col("e.link").getItem(0)["_href"]).alias("url"),
                 F.col("e.id").alias("guid"), F.col("e.summary").alias("summary"),
                 F.col("e.content").alias("content"), F.col("e.author.name").alias("author"),
                 F.coalesce(F.col("e.published"), F.col("e.updated")).alias("published_raw")))
    return r.unionByName(a)


def upsert_articles(new: DataFrame, existing: DataFrame, key: str = "canonical_url",
                    order_cols=("fetched_at",)) -> DataFrame:
    """Upsert unique by ``key``: one row per key, the greatest ``order_cols``
    wins (new rows should carry a later order value than stored ones).

    ``max_by`` over a struct is algebraic, so Spark pre-aggregates per key on the
    map side: a URL repeated millions of times ships one row per map task.
    """
    cols = [c for c in existing.columns]
    u = existing.unionByName(new.select(*cols))
    payload = F.struct(*[F.col(c) for c in cols if c != key])
    win = F.max_by(payload, F.struct(*[F.col(c) for c in order_cols]))
    return u.groupBy(key).agg(win.alias("_w")).select(key, "_w.*").select(*cols)


def feed_body(entries: DataFrame, pages: DataFrame, min_words: int = 100) -> DataFrame:
    """Use the entry's own content when it is full (>= min_words words),
    else the text extracted from the fetched page with the same canonical URL."""
    from inkwell.functions.text import word_count
    e = entries.withColumn("_k", canonical_url("url"))
    p = (pages.select(canonical_url("url").alias("_k"), F.col("text").alias("_page_text"), "page_id")
         .groupBy("_k").agg(F.max_by("_page_text", "page_id").alias("_page_text")))
    j = e.join(p, "_k", "left")
    full = word_count(F.col("content")) >= min_words
    return (j.withColumn("body", F.when(full, F.col("content")).otherwise(
        F.coalesce(F.col("_page_text"), F.col("content"), F.col("summary"))))
        .withColumn("body_origin", F.when(full, F.lit("feed"))
                    .when(F.col("_page_text").isNotNull(), F.lit("page")).otherwise(F.lit("feed_partial")))
        .drop("_k", "_page_text"))


ARTICLE_COLUMNS = ("url", "title", "content", "summary", "language", "category_slug", "image_url", "author",
                   "publish_time", "source_name")


def to_articles(*dfs: DataFrame) -> DataFrame:
    """Union scraper outputs into the one Article schema (missing columns null)."""
    shaped = []
    for df in dfs:
        keep = [c for c in df.columns if c in ARTICLE_COLUMNS]
        shaped.append(df.select(*keep))
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shaped)
    for c in ARTICLE_COLUMNS:
        if c not in u.columns:
            u = u.withColumn(c, F.lit(None).cast("timestamp_ntz" if c == "publish_time" else "string"))
    return u.select(*ARTICLE_COLUMNS)
