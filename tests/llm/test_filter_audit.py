"""Operator 11 against its SQL, a simulation of every order, and odd rows."""

from itertools import permutations

import __spark_entry__ as entry
from inkwell.llm import filter_audit as A
from tests.conftest import MID, SMALL
from tests.oracle import compare, duck_connect

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def fails(text, first):
    text = text or ""
    w = [x for x in __import__("re").split(A.SPACE, text) if x]
    checks = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
              any(c in "#$%&*|" for c in text), not first)
    return {c for c, bad in zip("ABCDE", checks) if bad}


def brute(docs, labels):
    """Every order is run over the rows themselves."""
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    rows = [(p or "", fails(t, i is None or smallest[t or ""] == i),
             any(a == i and q == 1 for a, q, _ in labels if i is not None), any(a == i and x == 1 for a, _, x in labels if i is not None))
            for i, t, p in docs]
    out, removals = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left, gone = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                now = [r for r in left if f in r[1]]
                left, before = [r for r in left if f not in r[1]], gone
                gone = gone + now
                out[part, order, step] = [len(left), len(now), sum(f in r[1] for r in before),
                                          sum(r[1] == {f} for r in rows if r[0] == part), sum(r[2] for r in now), sum(r[3] for r in now)]
                removals[part, f] = removals.get((part, f), 0) + len(now)
    return sorted((*k, *v, removals[k[0], k[1][k[2] - 1]]) for k, v in out.items())


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def got(spark, docs, labels):
    counts = A.combinations(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    return sorted(map(tuple, A.interactions(counts).select(COLUMNS).collect()))


def test_against_sql(spark):
    for d in (SMALL, MID):
        r = compare(spark, duck_connect(d), "op11", A.op11_filter_audit, A.SQL, d)
        assert r["status"] == "ok", r
    assert entry.oracle_sql()["op11_filter_audit"] == A.SQL


def test_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(120))
    docs = [(1, many, "en"), (2, many, "en"), (2, many, "en"), (1, many, "en"), (3, many, None), (4, None, "en"), (5, "", "en"),
            (6, "A B C", None), (7, many + " $", "de"), (8, "x " * 200, "de"), (9, "\x0bx\x0c" * 150, "de"), (None, many, "en"),
            (None, None, None), (None, None, None), (10, "A" * 300_000, "fr"), (11, "Ä" * 50 + " é", "fr"), (12, "w " * 99 + "w\xa0v", "fr"),
            (1, "another text", "en"), (13, "another text", "en")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (None, 1, 1), (9, 1, None), (99, 1, 1)]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_a_hot_text_and_equal_hashes(spark, monkeypatch):
    docs = [(i, "hot text" if i % 3 == 0 else f"text {i // 2}", "en") for i in range(400)]
    assert got(spark, docs, []) == brute(docs, [])
    monkeypatch.setattr(A, "SLICES", 4)
    assert got(spark, docs, []) == brute(docs, [])
    monkeypatch.setattr(A.F, "xxhash64", lambda *c: A.F.lit(7).cast("long"))
    frame = spark.createDataFrame(docs, DOCS)
    assert sorted(r.doc_id for r in A.later_copies(frame).collect()) == [i for i, t, _ in docs if any(t == u and j < i for j, u, _ in docs)]


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, [], [(1, 1, 1)]) == []
    docs = spark.createDataFrame([(1, "a b", "en", 5, 6, "q"), (2, "a b", "en", 5, 6, "q")],
                                 "doc_id long, text string, lang string, bits int, hash int, quality string")
    labels = spark.createDataFrame([(1, 1, 0, "t", "en")], "doc_id long, quality int, toxic int, text string, part string")
    rows = A.interactions(A.combinations(docs, labels))
    assert sorted(map(tuple, rows.select(COLUMNS).collect())) == brute([(1, "a b", "en"), (2, "a b", "en")], [(1, 1, 0)])
