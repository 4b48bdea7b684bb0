"""I7 typo expansion against a brute-force character-level edit distance."""

from pyspark.sql import functions as F

from inkwell.functions.text import tokens
from inkwell.operators import search as S
from inkwell.sources.tables import read_table
from tests.conftest import SMALL


def _lev(a: str, b: str) -> int:
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _budget(t: str) -> int:
    return 2 if len(t) >= 9 else 1 if len(t) >= 5 else 0


def test_expand_terms_matches_brute_force(spark):
    q = read_table(spark, SMALL, "benchmark").select(F.explode(tokens("text")).alias("term")).distinct()
    v = (read_table(spark, SMALL, "documents").where("doc_id < 20")
         .select(F.explode(tokens("text")).alias("term")).distinct())
    got = {(r.query_term, r.vocab_term, r.distance) for r in S.expand_terms(q, v).collect()}
    qs = [r.term for r in q.collect()]
    vs = [r.term for r in v.collect()]
    want = set()
    for a in qs:
        d = _budget(a)
        for b in vs:
            if abs(len(a) - len(b)) <= d:
                k = _lev(a, b)
                if k <= d:
                    want.add((a, b, k))
    assert got == want
    assert want  # the fixture produces matches
