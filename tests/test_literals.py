"""Small literal cases for operators whose inputs the driver tables do not hold."""

import json

from pyspark.sql import functions as F

from inkwell.operators import content as E
from inkwell.operators import ingest as IG
from inkwell.operators import registry as A
from inkwell.operators import users as U


def _write(tmp_path, name, obj):
    p = tmp_path / name
    p.write_text(obj if isinstance(obj, str) else json.dumps(obj), encoding="utf-8")


def test_configs_validate_and_merge(spark, tmp_path):
    _write(tmp_path, "a_test.json", {"name": "Test Source", "base_url": "https://t.example", "scrape_type": "rss",
                                      "language": "en", "category_slug": "national", "feed_url": "https://t/rss",
                                      "priority": 1})
    _write(tmp_path, "b_hindi.json", {"name": "Hindi Source", "base_url": "https://h.example",
                                       "scrape_type": "playwright", "language": "hi", "priority": 2})
    _write(tmp_path, "c_inactive.json", {"name": "Inactive", "base_url": "https://i.example", "scrape_type": "static",
                                          "category_slug": "sports", "priority": 3, "is_active": False})
    _write(tmp_path, "d_bad.json", "{not json")
    _write(tmp_path, "e_missing.json", {"name": "No Url", "scrape_type": "rss"})
    cfg = A.load_source_configs(spark, str(tmp_path))
    valid, rejects = A.validate_sources(cfg)
    assert valid.count() == 3
    assert sorted(r.reject_reason for r in rejects.collect()) == ["malformed_json", "missing_base_url"]
    h = valid.where("name = 'Hindi Source'").first()
    assert (h.category_slug, h.rate_limit_seconds, h.is_active) == ("national", 2.0, True)
    db = spark.createDataFrame([("Test Source", "https://other.example", "rss", "en", None, None, None, 1),
                                ("DB Only", "https://db.example", "static", None, None, None, None, 2)],
                               "name string, url string, scrape_type string, language string, category_slug string,"
                               " is_active boolean, feed_url string, db_seq long")
    m = A.merge_sources(valid, db)
    assert m.count() == 4
    assert m.where("source_key = 'test_source'").first().base_url == "https://t.example"  # JSON wins
    assert A.filter_sources(m, active_only=True).count() == 3
    assert A.filter_sources(m, language="hi").count() == 1


def test_health_rule(spark):
    log = spark.createDataFrame(
        [(1, "2024-01-01 00:00:00", "s1", "success")] + [(i, f"2024-01-01 00:0{i}:00", "s1", "error") for i in range(2, 7)]
        + [(10, "2024-01-01 00:00:00", "s2", "success"), (11, "2024-01-01 00:01:00", "s2", "success"),
           (20, "2024-01-01 00:00:00", "s3", "error")],
        "seq long, ts string, source_name string, status string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    src = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "source_name string")
    h = {r.source_key: r for r in A.source_health(log, src).collect()}
    assert not h["s1"].is_healthy and h["s1"].error_count == 5
    assert h["s2"].is_healthy
    assert not h["s3"].is_healthy  # first-ever error: rate 0
    full = {r.source_key: r.health for r in A.sources_with_health(src, A.source_health(log, src)).collect()}
    assert full["s4"].is_healthy and full["s4"].success_rate == 1.0
    runs = {r.source_name: r for r in A.failure_runs(log, "2024-01-02 00:00:00").collect()}
    assert runs["s1"].consecutive_failures == 5 and runs["s1"].unhealthy and runs["s1"].retry_eligible


def test_parse_feeds(spark):
    rss = ("<rss version=\"2.0\"><channel><title>x</title><item><title>One</title><link>https://a.example/1</link>"
           "<pubDate>Tue, 10 Jun 2003 04:00:00 GMT</pubDate></item><item><title>Two</title>"
           "<link>https://a.example/2</link></item></channel></rss>")
    atom = ("<feed xmlns=\"http://www.w3.org/2005/Atom\"><entry><title>Three</title>"
            "<link href=\"https://b.example/3\"/><id>3</id><updated>2003-12-13T18:30:02Z</updated></entry></feed>")
    df = spark.createDataFrame([("a", rss), ("b", atom)], "source_name string, xml string")
    out = IG.parse_feeds(df).orderBy("title").collect()
    assert [r.title for r in out] == ["One", "Three", "Two"]
    assert out[1].url == "https://b.example/3" and out[1].feed_format == "atom"


def test_update_sources(spark):
    ex = spark.createDataFrame([("s1", 1, 0.5), ("s2", 2, 0.9)], "source_name string, priority int, reliability_score double")
    ch = spark.createDataFrame([("s1", 1, None, 0.7), ("s1", 2, 3, None), ("s3", 1, 1, 1.0)],
                               "source_name string, changed_at int, priority int, reliability_score double")
    out = {r.source_name: r for r in A.update_sources(ex, ch).collect()}
    assert out["s1"].priority == 3 and out["s1"].reliability_score == 0.5
    assert out["s2"].priority == 2 and out["s3"].reliability_score == 1.0


def test_feed_body(spark):
    long = " ".join(["word"] * 120)
    entries = spark.createDataFrame([("https://a.example/1", long, None), ("https://a.example/2?utm_source=x", "short", "sum")],
                                    "url string, content string, summary string")
    pages = spark.createDataFrame([(1, "https://a.example/2", "page text")], "page_id long, url string, text string")
    out = {r.url: r for r in IG.feed_body(entries, pages).collect()}
    assert out["https://a.example/1"].body_origin == "feed"
    assert out["https://a.example/2?utm_source=x"].body == "page text"


def test_validate_images(spark):
    meta = spark.createDataFrame([(1920, 1080, 400_000, "ok"), (100, 300, 10, "ok"), (1000, 1000, 900_000, "ok")],
                                 "width int, height int, bytes long, status string")
    r = E.validate_images(meta).collect()
    assert r[0].usable and (r[0].crop_w, r[0].crop_h) == (1920, 1080) and r[0].within_budget
    assert not r[1].usable
    assert (r[2].crop_w, r[2].crop_h, r[2].crop_y) == (1000, 562, 219) and not r[2].within_budget


def test_apply_patches(spark):
    prefs = spark.createDataFrame([(1, "en", "a,b,c", True)],
                                  "user_id long, preferred_languages string, preferred_categories string, notification_enabled boolean")
    req = spark.createDataFrame([(1, 1, None, ["hi"], None), (1, 2, ["x"], None, False), (2, 1, ["a", "b", "c"], [], None)],
                                "user_id long, ts long, categories array<string>, languages array<string>, notification_enabled boolean")
    out, bad = U.apply_patches(req, prefs)
    rows = {r.user_id: r for r in out.collect()}
    assert rows[1].preferred_languages == "hi" and rows[1].preferred_categories == "a,b,c"
    assert rows[1].notification_enabled is True  # the rejected patch changed nothing
    assert rows[2].preferred_categories == "a,b,c" and rows[2].preferred_languages == ""
    assert bad.count() == 1


def test_comment_subtree_delete(spark):
    c = spark.createDataFrame([(1, 9, None), (2, 9, 1), (3, 9, 2), (4, 9, 1), (5, 9, None)],
                              "comment_id long, item_id long, parent_id long")
    out = U.comment_threads(c, spark.createDataFrame([(2,)], "comment_id long"))
    assert sorted(r.comment_id for r in out.collect()) == [1, 4, 5]
    full = {r.comment_id: r for r in U.comment_threads(c).collect()}
    assert full[3].depth == 2 and full[3].path == "1/2/3" and full[1].reply_count == 2
