"""Findings of round 3: what is shuffled for vectors and summaries, calls to the state store, audits of filters at any size."""

import re
from datetime import date
from types import SimpleNamespace

import pytest

from inkwell.llm import filter_audit as A
from inkwell.operators import content as E
from inkwell.operators import quality as C
from inkwell.operators import similarity as S
from inkwell.streaming import keyed as K


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


DOCS = [(1, "a b b c"), (2, "b c"), (3, "c d e"), (4, ""), (5, None), (6, "a b b c"), (None, "a b"), (2, "e e a")]


def test_sums_of_vectors_are_not_shuffled(spark):
    docs = spark.createDataFrame(DOCS, "article_id long, content string")
    lines = [x for x in plan_of(S.embed(docs, S.fit_embedder(docs))).splitlines() if "HashAggregate" in x or "Exchange" in x]
    wide = [i for i, x in enumerate(lines) if re.search(r"functions=\[sum\(", x)]
    assert wide and all("partial_sum" in lines[i + 1] for i in wide)


def test_vectors_are_the_same_without_the_whole_model_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "article_id long, content string")
    model = S.cut_lineage(S.fit_embedder(docs))

    def vectors():
        rows = S.embed(docs, model).collect()
        return sorted(((r[0] or 0, tuple(round(x, 9) + 0.0 for x in r[1] or ())) for r in rows), key=repr)

    whole = vectors()
    monkeypatch.setattr(S, "BROADCAST_ROWS", 2)
    assert vectors() == whole and len(whole) == len(DOCS) and len(whole[-1][1]) == S.DIM


def test_summaries_shuffle_by_id_alone(spark):
    rows = [(1, "One two. Two two three! ... -- ? End here."), (2, ""), (3, None), (None, "x y."), (4, "w " * 90), (5, "a b. c."), (5, "a d. e f.")]
    df = spark.createDataFrame(rows, "article_id long, body string")
    out = E.extractive_summary(df, "article_id", "body")
    assert not re.search(r"hashpartitioning\(_id#\d+L?, (term|pos)", plan_of(out))
    got = sorted(map(tuple, out.select("article_id", "summary", "summary_words", "reason").collect()), key=repr)
    merged = got[4][1].split(". ")
    assert got[4] == got[5] and sorted(merged) == sorted(["a b", "c.", "a d", "e f."]) and got[4][2] == 7
    assert got[:4] == [(1, "One two. Two two three. --. End here.", 8, None), (2, None, 0, "no_text"), (3, None, 0, "no_text"),
                       (4, None, 0, "long_sentences")] and got[6] == (None, None, 0, "no_text")


def test_body_is_all_after_the_first_line(spark):
    texts = ["t\nb", "t", "", None, "\n", "t\n", "t\n\nb\n", "é\n\U0001f600 b\r\nc"]
    df = spark.createDataFrame([(x,) for x in texts], "content string")
    want = [None if x is None else x.partition("\n")[2] for x in texts]
    assert [r[0] for r in df.select(C.body_of("content")).collect()] == want


@pytest.mark.parametrize("stored", [None, (1,)])
def test_a_key_of_the_comment_limit_makes_few_calls(stored):
    calls = []
    state = SimpleNamespace(get=lambda: calls.append("get") or stored, update=lambda x: calls.append(("update", x)))
    handle = SimpleNamespace(getValueState=lambda *_: state, registerTimer=lambda ms: calls.append(("timer", ms)))
    limiter = K.CommentLimiter(2)
    limiter.init(handle)
    rows = [SimpleNamespace(us=u, event_id=e, item_id=7) for u, e in ((5, 2), (5, None), (4, 3))]
    out = [(r.us, r.event_id, r.day_rank) for r in limiter.handleInputRows((1, date(2024, 1, 2)), iter(rows), None)]
    first = [(4, 3, 1), (5, None, 2)]
    assert out == (first if stored is None else [(4, 3, 2)])
    assert calls == ["get", *([("timer", 1704240000000)] if stored is None else []), ("update", (2,))]


def test_texts_are_shuffled_whatever_the_number_of_hashes(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "doc_id long, text string")
    found = A.later_copies(docs)
    assert sorted(r.doc_id for r in found.collect()) == [3, 4, 5, 6, 7, 8]
    assert re.search(r"SortMergeJoin.*\[hash#\S+ slice#\S+ \[hash#\S+ slice#", plan_of(found).split("Initial Plan")[0])
