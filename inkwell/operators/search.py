"""Feed paging and filters (I1-I4) and search.

The inverted index is a postings DataFrame (term, doc_id, tf) plus per-document
lengths; BM25 joins the (small, per batch) query-term table to the postings on
the term, so a very common term's posting list is streamed, never shuffled to one
task, and per-(query, doc) sums are pre-aggregated map-side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import tokens
from inkwell.functions.time import time_ago
from inkwell.session import cut_lineage, sized_broadcast

BM25_K1 = 1.2
BM25_B = 0.75


def page(df: DataFrame, order: list[str], cursor: tuple | None, n: int, desc: bool = True) -> DataFrame:
    """Keyset page: rows strictly after ``cursor`` in (order...) order, ``n``
    rows, ``next_cursor_*`` columns on the last row (null at the end)."""
    cols = [F.col(c) for c in order]
    d = df
    if cursor is not None:
        # Lexicographic "after" predicate on the composite key.
        cond = None
        for i in range(len(order)):
            eq = [cols[j] == F.lit(cursor[j]) for j in range(i)]
            cmp = (cols[i] < F.lit(cursor[i])) if desc else (cols[i] > F.lit(cursor[i]))
            term = cmp
            for e in eq:
                term = term & e
            cond = term if cond is None else cond | term
        d = d.where(cond)
    ordering = [c.desc() for c in cols] if desc else cols
    top = d.orderBy(*ordering).limit(n + 1)
    w = Window.orderBy(*ordering)  # over at most n + 1 rows
    t = top.withColumn("_pos", F.row_number().over(w)).withColumn("_cnt", F.count("*").over(Window.partitionBy()))
    t = t.where(F.col("_pos") <= n)
    last = (F.col("_pos") == n) & (F.col("_cnt") > n)
    out = t
    for c in order:
        out = out.withColumn(f"next_cursor_{c}", F.when(last, F.col(c)))
    return out.withColumnRenamed("_pos", "position").drop("_cnt")


def feed_filter(df: DataFrame, language: str, categories=None, since=None, until=None) -> DataFrame:
    """Language is required; categories and a time range are optional."""
    if not language:
        raise ValueError("language is required")
    d = df.where(F.col("language") == language)
    if categories:
        d = d.where(F.col("category_slug").isin(*categories))
    if since is not None:
        d = d.where(F.col("publish_time") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        d = d.where(F.col("publish_time") <= F.lit(until).cast("timestamp_ntz"))
    return d


def default_feed(users: DataFrame, trending: DataFrame, pref_top: DataFrame, k: int = 20) -> DataFrame:
    """Feed for new users: trending items of the user's language interleaved
    with top items of the preferred categories (trending first at each rank); an
    item appears once, at its first slot. trending: language, article_id, rank;
    pref_top: user_id, article_id, rank."""
    t = users.select("user_id", "language").join(trending.select("language", "article_id", "rank"), "language") \
        .select("user_id", "article_id", (F.col("rank") * 2 - 1).alias("_slot"))
    p = pref_top.select("user_id", "article_id", (F.col("rank") * 2).alias("_slot"))
    u = t.unionByName(p).groupBy("user_id", "article_id").agg(F.min("_slot").alias("_slot"))
    w = Window.partitionBy("user_id").orderBy("_slot", "article_id")
    return u.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).drop("_slot")


def feed_items(feed: DataFrame, articles: DataFrame, counts: DataFrame, as_of) -> DataFrame:
    """I4: feed rows projected with title, category, counts and time-ago."""
    a = articles.select("article_id", "title", "category_slug", "publish_time")
    c = counts.select(F.col("item_id").alias("article_id"), "reads", "likes", "comments", "shares", "bookmarks")
    j = feed.join(a, "article_id").join(c, "article_id", "left")
    return j.select("user_id", "position", "article_id", "title", "category_slug", "publish_time",
                    *[F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias(x)
                      for x in ("reads", "likes", "comments", "shares", "bookmarks")],
                    time_ago(F.col("publish_time"), as_of).alias("time_ago"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(postings(term, doc_id, tf, language), doc_stats(doc_id, language, doc_len)).

    Tokens are exploded and counted per (term, doc): the aggregate is keyed by
    both, so a stop word present everywhere spreads over all reducers.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(lang).alias("language"), tokens(text).alias("_t"))
    stats = t.select("doc_id", "language", F.size("_t").alias("doc_len"))
    post = (t.select("doc_id", "language", F.explode("_t").alias("term"))
            .groupBy("term", "doc_id", "language").agg(F.count("*").alias("tf")))
    return post, stats


def term_stats(postings: DataFrame) -> DataFrame:
    """Document frequency and collection frequency per (language, term)."""
    return postings.groupBy("language", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def search(postings: DataFrame, stats: DataFrame, queries: DataFrame, k: int = 10,
           k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """BM25 top-k per query. queries: query_id, query (text).

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); each distinct query term counts once.
    Collection size and average length are scalar subqueries. Lengths and the postings of query terms are written once, as
    counts and scores read them again; where the query terms are few they reach the tokens before these are counted.
    """
    stats = cut_lineage(stats.select("doc_id", "doc_len"))
    n_docs = stats.agg(F.count("*")).scalar()
    avgdl = stats.agg(F.avg("doc_len")).scalar()
    qt = queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term"))
    asked = sized_broadcast(qt.select("term").distinct())
    postings = cut_lineage(postings.select("term", "doc_id", "tf").join(asked, "term", "left_semi"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    qterms = qt.join(df, "term")
    j = qterms.join(postings.select("term", "doc_id", "tf"), "term").join(stats.select("doc_id", "doc_len"), "doc_id")
    idf = F.log(F.lit(1.0) + (n_docs - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    tfn = F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("doc_len") / avgdl))
    # Scores are rounded to 1e-9 before ranking so that float summation order
    # (which differs between engines and partitionings) cannot reorder ties.
    scored = j.groupBy("query_id", "doc_id").agg(F.round(F.sum(idf * tfn), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _deletions(col, d: int):
    """All strings obtained by deleting up to ``d`` characters (d in 0..2)."""
    one = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)),
                                lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    first = F.array_union(F.array(col), one(col))
    if d == 1:
        return first
    second = F.flatten(F.transform(first, lambda s: F.array_union(F.array(s), one(s))))
    return F.array_distinct(second)


def edit_budget(term):
    """Length >= 9 → 2 edits, >= 5 → 1 edit, else exact."""
    n = F.length(term)
    return F.when(n >= 9, F.lit(2)).when(n >= 5, F.lit(1)).otherwise(F.lit(0))


def expand_terms(query_terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Vocabulary terms within the query term's edit budget.

    Blocking by deletion neighbourhoods: two strings within edit distance d share
    a string reachable by at most d deletions from each, so candidates come from an
    equi-join on those keys; ``levenshtein(a, b, 2)`` then verifies exactly.
    """
    q = query_terms.select(F.col("term").alias("q")).distinct().withColumn("_d", edit_budget(F.col("q")))
    v = vocab.select(F.col("term").alias("v")).distinct()
    qk = q.select("q", "_d", F.explode(F.when(F.col("_d") == 2, _deletions(F.col("q"), 2))
                                       .when(F.col("_d") == 1, _deletions(F.col("q"), 1))
                                       .otherwise(F.array(F.col("q")))).alias("key"))
    vk = v.select("v", F.explode(_deletions(F.col("v"), 2)).alias("key"))
    cand = qk.join(vk, "key").select("q", "_d", "v").distinct()
    dist = F.levenshtein(F.col("q"), F.col("v"), 2)
    return (cand.withColumn("distance", dist)
            .where((F.col("distance") >= 0) & (F.col("distance") <= F.col("_d")))
            .select(F.col("q").alias("query_term"), F.col("v").alias("vocab_term"), "distance"))


def facets(hits: DataFrame) -> DataFrame:
    """I8: hit counts by category, by source and by publish date (grouping sets)."""
    h = hits.withColumn("publish_date", F.to_date("publish_time"))
    return (h.groupingSets([["category_slug"], ["source_name"], ["publish_date"]],
                           "category_slug", "source_name", "publish_date")
            .agg(F.count("*").alias("hits"), F.grouping_id().alias("facet_id")))


def search_or_trending(postings: DataFrame, stats: DataFrame, queries: DataFrame, trending: DataFrame,
                       k: int = 10) -> DataFrame:
    """Empty queries get the trending list (trending: doc_id, rank), others BM25."""
    empty = F.trim(F.coalesce(F.col("query"), F.lit(""))) == ""
    hits = search(postings, stats, queries.where(~empty), k).select("query_id", "doc_id", "rank", F.lit("search").alias("source"))
    # The trending top-k (k rows, bounded by the parameter) as one array value.
    top = (trending.where(F.col("rank") <= k)
           .agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id")))).scalar())
    tr = (queries.where(empty).select("query_id", F.explode(top).alias("t"))
          .select("query_id", F.col("t.doc_id").alias("doc_id"), F.col("t.rank").alias("rank"),
                  F.lit("trending").alias("source")))
    return hits.unionByName(tr)


def sync_index(postings: DataFrame, stats: DataFrame, added: DataFrame, deleted: DataFrame,
               **kw) -> tuple[DataFrame, DataFrame]:
    """Drop deleted documents and index newly added ones (anti-join + union)."""
    new_post, new_stats = build_index(added, **kw)
    gone = deleted.select(F.col(deleted.columns[0]).alias("doc_id"))
    p = postings.join(gone, "doc_id", "left_anti").join(new_post.select("doc_id").distinct(), "doc_id", "left_anti")
    s = stats.join(gone, "doc_id", "left_anti").join(new_stats.select("doc_id"), "doc_id", "left_anti")
    keep_new = new_post.join(gone, "doc_id", "left_anti")
    keep_new_stats = new_stats.join(gone, "doc_id", "left_anti")
    return p.unionByName(keep_new), s.unionByName(keep_new_stats)


def bm25_idf(n_docs: int, df: int) -> float:
    return math.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))
