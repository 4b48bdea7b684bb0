"""Literal cases behind the review's findings on summaries, logins, stories and the quality gate."""

import datetime as dt

from inkwell.operators.content import extractive_summary, validate_summaries
from inkwell.operators.quality import boilerplate_overlap, quality_gate, tag_quality
from inkwell.operators.users import resolve_users

USERS = "user_id long, email string, google_id string, role string, last_login_at timestamp_ntz"
LOGINS = "login_ts timestamp_ntz, google_id string, email string"


def at(hour):
    return dt.datetime(2024, 1, 1, hour)


def test_every_article_has_a_summary_row(spark):
    long = " ".join(["word"] * 90)
    rows = [(1, "First one here. Second one there"), (2, long), (3, ""), (4, None), (5, long + ". Short end")]
    df = spark.createDataFrame(rows, "article_id long, body string")
    got = {r.article_id: r for r in extractive_summary(df).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert (got[1].summary, got[1].summary_words, got[1].reason) == ("First one here. Second one there", 6, None)
    assert (got[2].summary, got[2].summary_words, got[2].reason) == (None, 0, "long_sentences")
    assert got[3].reason == got[4].reason == "no_text"
    assert got[5].summary == "Short end"


def test_no_summary_is_not_valid(spark):
    df = spark.createDataFrame([(1, None, "Title 5"), (2, "x", None)], "i int, summary string, title string")
    assert [r.valid for r in validate_summaries(df).orderBy("i").collect()] == [False, False]


def test_logins_sharing_an_email(spark):
    users = spark.createDataFrame([(1, "a@x", None, "reader", None), (2, "b@x", "old", "reader", at(1))], USERS)
    logins = spark.createDataFrame([(at(3), "z1", "a@x"), (at(5), "a2", "a@x"), (at(4), "new", "b@x"),
                                    (at(2), "n1", "c@x"), (at(6), "n0", "c@x"), (at(7), "m1", None), (at(8), "m2", None)], LOGINS)
    rows = resolve_users(logins, users).collect()
    got = {r.user_id: (r.email, r.google_id, r.last_login_at) for r in rows}
    assert len(rows) == 5
    assert got[1] == ("a@x", "a2", at(5))
    assert got[2] == ("b@x", "new", at(4))
    assert [got[i] for i in (3, 4, 5)] == [("c@x", "n0", at(6)), (None, "m1", at(7)), (None, "m2", at(8))]


def test_boilerplate_counts_repeats_and_corpus(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(5)] + [(5, "x y z"), (6, "p q r"), (7, ""), (8, None)],
                                 "doc_id long, text string")
    corpus = spark.createDataFrame([("x y z",), ("not in any",)], "text string")
    got = {r.doc_id: (r.n_shingles, r.corpus_share, r.repeated_share)
           for r in boilerplate_overlap(docs, corpus, n=3, min_docs=5).collect()}
    assert got[0] == (1, 0.0, 1.0) and got[5] == (1, 1.0, 0.0) and got[6] == (1, 0.0, 0.0)
    assert got[7] == (0, 0.0, 0.0) and got[8][1:] == (0.0, 0.0)


def test_gate_splits_the_tagged_frame(spark):
    df = spark.createDataFrame([(1, 0.9, 200, False, False, True, 0.0, 0.0), (2, 0.1, 50, True, True, False, 0.0, 0.9)],
                               "article_id long, quality_score double, body_words int, clickbait boolean, sponsored boolean, "
                               "meaningful boolean, corpus_share double, repeated_share double")
    tags = {r.article_id: r.reasons for r in tag_quality(df).collect()}
    assert tags[1] == [] and len(tags[2]) == 6
    accepted, rejected = quality_gate(df)
    assert [r.article_id for r in accepted.collect()] == [1] and [r.article_id for r in rejected.collect()] == [2]
