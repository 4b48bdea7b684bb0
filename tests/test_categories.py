"""Category assignment: overlapping prefixes, keywords of every category, defaults, and the registered query's branches."""

from pyspark.sql import functions as F

from inkwell.operators.categories import KEYWORDS, assign_category, url_path
from inkwell.plans.q_ingest import b4_assign_category
from tests.conftest import MID

# Part of a real source's map, with its overlap.
RULES = [("ndtv", "/india-news/", "national"), ("ndtv", "/india-news/crime", "crime"), ("ndtv", "/auto/", "automobile"),
         ("twice", "/a", "sports"), ("twice", "/a", "health")]


def assigned(spark, rows):
    articles = spark.createDataFrame(rows, "id int, source_key string, url string, content string")
    rules = spark.createDataFrame([*RULES, ("ndtv", None, "jobs")], "source_key string, prefix string, category_slug string")
    defaults = spark.createDataFrame([("ndtv", "politics"), ("plain", "business")], "source_key string, category_slug string")
    out = assign_category(articles, rules, defaults)
    assert out.columns == ["id", "source_key", "url", "content", "category_slug", "category_by"]
    return {r.id: (r.category_slug, r.category_by) for r in out.collect()}


def test_longest_prefix_then_keywords_then_default(spark):
    rows = [(1, "ndtv", "https://www.ndtv.com/india-news/some-article?x=/auto/", "cricket"),
            (2, "ndtv", "https://www.ndtv.com/india-news/crime-in-delhi", None), (3, "ndtv", "https://www.ndtv.com/auto/", ""),
            (4, "ndtv", "https://www.ndtv.com/auto", "Cricket and football, not one exam; cricket"), (5, "ndtv", "https://www.ndtv.com", "nothing"),
            (6, "plain", "https://x.org/india-news/", "Mutual funds rise"), (7, "plain", "https://x.org/", "mutual and funds"),
            (8, "unknown", None, None), (9, None, "https://x.org/", "Space research"), (10, "twice", "https://t.org/a/b", "x"),
            (11, "plain", "https://x.org", "cricket crypto"), (12, "plain", "https://x.org", "GDP"), (13, "ndtv", "nonsense", "TV!")]
    assert assigned(spark, rows) == {
        1: ("national", "prefix"), 2: ("crime", "prefix"), 3: ("automobile", "prefix"), 4: ("sports", "keyword"), 5: ("politics", "default"),
        6: ("finance", "keyword"), 7: ("business", "default"), 8: ("national", "default"), 9: ("science", "keyword"), 10: ("health", "prefix"),
        11: ("finance", "keyword"), 12: ("business", "keyword"), 13: ("entertainment", "keyword")}
    assert assigned(spark, []) == {}


def test_keywords_reach_all_categories(spark):
    rows = [(i, "plain", "https://x.org", f"about {w.upper()}.") for i, w in enumerate(w for ws in KEYWORDS.values() for w in ws)]
    want = [slug for slug, ws in KEYWORDS.items() for _ in ws]
    got = assigned(spark, rows)
    assert [got[i] for i in range(len(rows))] == [(s, "keyword") for s in want] and len(set(want)) == 19


def test_paths(spark):
    urls = ["https://a.b/c/d?e#f", "HTTP://a.b", "https://a.b?x=/y", "a/b", "", None, "ftp://h:1/p/#z"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_path("u")).collect()]
    assert got == ["/c/d", "/", "/", "/", "/", None, "/p/"]


def test_query_takes_every_branch(spark):
    got = {r.category_by: r.n for r in b4_assign_category(spark, MID).groupBy("category_by").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {"prefix", "keyword", "default"}
