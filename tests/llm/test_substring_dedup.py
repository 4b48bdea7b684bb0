"""Operator 2 against brute force over all runs, and literal cases."""

import random

from inkwell.llm import substring_dedup as S
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string"


def brute(rows):
    """The cleaned texts by a dictionary of the runs themselves."""
    seen, out = {}, {}
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    hit = {}
    for none, i, t in order:
        ends, words = S.units(t)
        for k in range(len(words) - S.RUN + 1):
            run = [w.lower() for u in words[k:k + S.RUN] for w in [" ".join(u)]]
            if sum(map(len, words[k:k + S.RUN])) >= S.LEAST_WORDS and seen.setdefault(tuple(run), (none, i, t, k)) != (none, i, t, k):
                hit.setdefault((none, i, t), set()).update(range(k, k + S.RUN))
    for key in order:
        ends, words = S.units(key[2])
        gone, covered = set(), hit.get(key, set())
        for u in covered:
            a = b = u
            while a - 1 in covered:
                a -= 1
            while b + 1 in covered:
                b += 1
            if sum(map(len, words[a:b + 1])) >= S.LEAST_SPAN:
                gone.add(u)
        out[key] = "".join(key[2][a:b] for n, (a, b) in enumerate(zip([0, *ends], ends)) if n not in gone) if gone else key[2]
    return sorted([(i, out[(i is None, i or 0, t or "")]) for i, t in rows], key=repr)


def got(df):
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=repr)


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(300)) for _ in range(n)).capitalize() + "."


def test_units_keep_every_character():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "bc", ". ", "! ", "\n", "  ", "。", "x" * 30 + " ", "d e f g "]) for _ in range(rng.randrange(80)))
        ends, words = S.units(text)
        assert "".join(w for u in words for w in u) == "".join(text.split()) and all(0 < len(u) <= S.LONGEST for u in words)
        assert ends == sorted(set(ends)) and (not ends or ends[-1] == len(text))


def test_passages_go_and_the_rest_stays(spark):
    rng = random.Random(5)
    passages = [" ".join(sentence(rng, n) for n in sizes) for sizes in ([12] * 5, [3, 20, 4, 15, 10], [56], [30, 25], [9] * 7)]
    rows = []
    for i in range(60):
        own = [" ".join(sentence(rng, rng.randrange(4, 12)) for _ in range(rng.randrange(1, 6))) for _ in range(2)]
        use = passages[i % 5] if i % 2 else ""
        rows.append((i, " ".join(x for x in (own[0], use, own[1]) if x)))
    common = passages[0]
    rows += [(i, sentence(rng, 8) + " " + common) for i in range(100, 220)]
    rows += [(None, common), (500, None), (501, ""), (502, " \n "), (503, "One. Two. Three."), (504, "One. Two. Three."),
             (505, sentence(rng, 10) + "\n" + (sentence(rng, 12) + " ") * 500), (0, rows[0][1]), (507, "w " * 60_000)]
    df = spark.createDataFrame([(*r, 3) for r in rows], SCHEMA + ", place int")
    out = got(S.cleaned(df))
    assert out == brute(rows)
    texts = [t for _, t in out]
    for p in passages:
        assert sum(" ".join(p.split()) in " ".join(t.split()) for t in texts) == 1
    assert dict(out)[500] == "" and dict(out)[503] == dict(out)[504] == "One. Two. Three."
    clean = {i: t for i, t in rows if i is not None and i < 60 and i % 2 == 0}
    assert all(dict(out)[i] == t for i, t in clean.items())


def test_given_documents_and_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(S.op2_substring_dedup(spark, SMALL)) == brute(rows)
    out = S.remove_repeats(docs)
    assert out.dtypes == docs.dtypes and got(out.select("doc_id", "text")) == brute(rows)
    assert out.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()
    assert S.cleaned(docs.limit(0)).count() == 0


def windows(texts, n):
    """How many texts hold each window of ``n`` words (characters of texts without spaces)."""
    held = {}
    for t in texts:
        words = t.split() if " " in t else list(t)
        for w in {tuple(words[k:k + n]) for k in range(len(words) - n + 1)}:
            held[w] = held.get(w, 0) + 1
    return held


def test_no_two_documents_keep_fifty_words(spark):
    """Passages of 50 words and more anywhere in running text, of which no sentence border is known."""
    rng = random.Random(8)
    word = lambda: rng.choice("the of and to".split()) if rng.random() < .4 else "w" + str(rng.randrange(5000))
    prose = lambda n: [word() + (rng.random() < .03) * "." for _ in range(n)]
    passages = [prose(n) for n in (50, 55, 60, 81, 200)]
    rows = [(i, " ".join(prose(rng.randrange(90)) + passages[i % 5] + prose(rng.randrange(90)))) for i in range(150)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows += [(10_000 + r.doc_id, r.text) for r in docs]
    assert max(windows([t or "" for _, t in rows], 50).values()) >= 30
    out = got(S.cleaned(spark.createDataFrame(rows, SCHEMA)))
    assert max(windows([t for _, t in out], 50).values()) == 1


def test_common_phrases_stay(spark):
    rng = random.Random(11)
    line = sentence(rng, 25)
    rows = [(i, " ".join([sentence(rng, 9), line, sentence(rng, 9)])) for i in range(30)]
    assert dict(got(S.cleaned(spark.createDataFrame(rows, SCHEMA)))) == dict(rows)


def test_short_sentences_and_scripts_without_spaces(spark):
    rng = random.Random(9)
    threes = " ".join(sentence(rng, 3) for _ in range(20))
    ones = " ".join("".join(rng.choice("EHDRWA") for _ in range(5)) + rng.choice(["!", ".!!", "."]) for _ in range(155))
    signs = "".join(chr(rng.randrange(0x4e00, 0x9000)) + (k % 9 == 8) * "。" for k in range(80))
    thai = "".join(chr(rng.randrange(0x0e01, 0x0e2f)) for _ in range(80))
    own = lambda lo, hi: "".join(chr(rng.randrange(lo, hi)) for _ in range(40))
    rows = [(i, sentence(rng, 9) + " " + threes + " " + sentence(rng, 9)) for i in range(40)] + [(100, ones), (101, ones)]
    rows += [(200 + i, own(0x4e00, 0x9000) + signs + own(0x4e00, 0x9000)) for i in range(10)]
    rows += [(300 + i, own(0x0e01, 0x0e2f) + thai + own(0x0e01, 0x0e2f)) for i in range(10)]
    out = dict(got(S.cleaned(spark.createDataFrame(rows, SCHEMA))))
    for first, last, size in ((0, 40, 30), (100, 102, 30), (200, 210, 50), (300, 310, 50)):
        assert out[first] == dict(rows)[first]
        assert max(windows([out[i] for i in range(first, last) if i in out], size).values()) == 1
    assert len(out[101].split()) < 30
