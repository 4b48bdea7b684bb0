"""Operator 8 against its SQL, literal cases and the joined form of the index."""

import pytest

import __spark_entry__ as entry
from inkwell.llm import url_filter as U
from tests.conftest import MID
from tests.oracle import compare, duck_connect

CASES = [
    (1, "http://a.com/x?q", "a.com", "/x", "com/", "allow"),
    (2, "https://Example.COM/en/1#t", "example.com", "/en/1", "example.com/en/", "block"),
    (3, "https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    (4, "https://m.www.example.com/en/a", "m.www.example.com", "/en/a", "www.example.com/en/", "allow"),
    (5, "https://notexample.com/en/a", "notexample.com", "/en/a", "com/", "allow"),
    (6, "https://example.com/english/a", "example.com", "/english/a", "com/", "allow"),
    (7, "http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
    (8, "http://b.net/ES/1", "b.net", "/ES/1", None, "allow"),
    (9, "http://a.com", "a.com", "", None, "allow"),
    (10, "http://spam-farm.org/x", "spam-farm.org", "/x", None, "block"),
    (11, "http://spammers.org/spam/", "spammers.org", "/spam/", None, "allow"),
    (12, None, "", "", None, "allow"),
    (13, "", "", "", None, "allow"),
    (14, "no-scheme.com/", "", "", None, "allow"),
    (15, "a://b.com/c://net/es/", "b.com", "/c://net/es/", "com/", "allow"),
    (16, "x" * 200_000 + "://k.net/fr/", "k.net", "/fr/", "net/fr/", "block"),
    (7, "http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
    (None, "http://com/", "com", "/", "com/", "allow"),
]


def _rows(df):
    return sorted(map(tuple, df.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)


def test_against_sql(spark):
    r = compare(spark, duck_connect(MID), "op8", U.op8_url_filter, U.SQL, MID)
    assert r["status"] == "ok", r
    assert entry.queries()["op8_url_filter"] and entry.oracle_sql()["op8_url_filter"]


@pytest.mark.parametrize("inline", [256, 0])
def test_literal_cases_in_both_forms(spark, inline):
    pages = spark.createDataFrame([(c[0], c[1], "v", "k") for c in CASES], "page_id long, url string, verdict string, key string")
    want = sorted([(c[0], c[2], c[3], c[4], c[5]) for c in CASES], key=repr)
    assert _rows(U.judge(pages, inline=inline)) == want


def test_rarest_token_and_rules_without_literal(spark):
    rules = (U.site_rule("block", "example.com/en/"), U.Rule("digits", "block", "[0-9]{4}", ()))
    pages = spark.createDataFrame([(i, f"http://h{i}.example.com/{'en' if i < 2 else 'de'}/{i}") for i in range(5)]
                                  + [(9, "http://q.org/1234")], "page_id long, url string")
    host, path = U.split_url(pages.url)
    keys = pages.select(U.F.concat(host, path).alias("key"))
    assert U.rule_index(keys, rules) == {"en": [0], None: [1]}
    for inline in (0, 9):
        got = {r.page_id: r.verdict for r in U.judge(pages, rules, inline).collect()}
        assert got == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow", 9: "block"}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(pages).count() == 0 and U.judge(pages, inline=0).count() == 0
    one = spark.createDataFrame([(1, "http://spam.org/")], "page_id long, url string")
    assert _rows(U.judge(one, ())) == [(1, "spam.org", "/", None, "allow")]
