"""Operator 13 against the contract's forms word for word, brute-force thresholds, planted tokens and odd rows."""

import hashlib
import random
import re
import string

import numpy as np

from inkwell.llm import secret_scan as S
from tests.conftest import SMALL

FORMS = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
         "access": (r"(AKIA[A-Z0-9]+)", 1, 20), "hex": (r"([0-9a-f]+)", 1, 24)}


def base(text):
    out = []
    for kind, (form, group, least) in FORMS.items():
        flags = re.I | re.A if kind == "assign" else 0
        out += [(kind, m.start(), m.end()) for m in re.finditer(form, text, flags) if len(m[group]) >= least]
    return out


def expected(rows):
    """The whole query by one list of p-values a class, sorted."""
    found = [(i, t or "", base(t or "")) for i, t in rows]
    tokens = []
    for k, (_, t, spans) in enumerate(found):
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", t):
            if not any(a < m.end() and m.start() < b for _, a, b in spans) and S.battery(m[0]):
                _, drawn, p = S.battery(m[0])
                p = 1.0 if drawn < S.REJECT else 10 ** -(min(S.BINS, int(-10 * np.log10(p))) / 10)
                tokens.append((len(m[0]).bit_length(), p, k, *m.span()))
    extra = {}
    for size in {t[0] for t in tokens}:
        own = sorted(t[1:] for t in tokens if t[0] == size)
        below = [p for r, (p, *_) in enumerate(own, 1) if p * len(own) <= S.FALSE * r]
        for p, k, a, b in own:
            if below and p <= max(below):
                extra.setdefault(k, []).append(("random", a, b))
    out = []
    for k, (i, _, spans) in enumerate(found):
        def line(s):
            return ",".join(f"{n}:{a}:{b}" for n, a, b in sorted(s, key=lambda x: (x[1], S.KINDS.index(x[0]))))
        out.append((i, *(sum(s[0] == n for s in spans) for n in FORMS), hashlib.sha256(line(spans).encode()).hexdigest(),
                    line(spans + extra.get(k, []))))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def result(spark, monkeypatch, rows, more=""):
    frame = spark.createDataFrame([(*r, *([1] if more else [])) for r in rows], "doc_id long, text string" + more)
    monkeypatch.setattr(S, "read_table", lambda *_: frame)
    got = S.op13_secret_scan(spark, "")
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=repr)


def drawn(rng, n, letters=string.ascii_letters + string.digits):
    return "".join(rng.choice(letters) for _ in range(n))


def test_query_on_small_table(spark):
    rows = S.read_table(spark, SMALL, "documents").select("doc_id", "text").collect()
    assert sorted(map(tuple, S.op13_secret_scan(spark, SMALL).collect()), key=repr) == expected(rows)


def test_known_forms():
    cases = ["password=abcdef", "PassWord : 'x.y=z-1'", "api_key=\"A/b+c_d\"", "apikey:12345", "token  =  = abcdefg", "secret\n=abcdef",
             "my secrettoken=abcdef", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7 + "x", "AKIAAKIA" * 4, "f" * 23, "f" * 24 + "g" + "0" * 30,
             "pſassword=abcdef", "toKen=abcdef", "password=abc password=abcdefg", "é" * 9 + " token=ghijkl", "token=" * 9, "Secret:\"'abcdefgh"]
    rng = random.Random(4)
    parts = ["password", "PASSWD", "token", "api", "_", "key", "=", ":", " ", "'", '"', "AKIA", "ABC12", "0af" * 5, "deadbeef", "xyz.", "é", "\n"]
    cases += ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text in cases:
        assert sorted(S.known(text)) == sorted(base(text)), text


def test_battery_is_calibrated():
    """Tokens drawn at random fail at about the stated rate; even, ordered and repeated ones do always."""
    rng = random.Random(9)
    for letters in (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase):
        failed = sum(S.battery(drawn(rng, n, letters))[1] < 0.05 for n in (16, 24, 32, 64, 200) for _ in range(400))
        assert failed < 0.08 * 2000, failed
    for token in (string.ascii_letters + string.digits, string.ascii_lowercase * 2, "ab" * 30, "Aa1" * 20, "a" * 20 + "B" * 20):
        assert S.battery(token)[1] < S.REJECT, token
    assert S.battery("1234567890123456") is None and S.battery("_-" * 9 + "+/") is None


def test_statistics_by_hand():
    v = np.array([0, 1, 2, 3, 3, 0])
    chi2, runs, serial = S.statistics(v, 4)
    assert np.isclose(chi2, sum((c - 1.5) ** 2 / 1.5 for c in (2, 1, 1, 2)))
    assert np.isclose(runs, (2 - 2.5) / np.sqrt(5 / 4))
    x = v - 1.5
    assert np.isclose(serial, sum(a * b for a, b in zip(x, x[1:])) / 1.25 / np.sqrt(5))


def test_planted_tokens_are_found_and_words_left(spark, monkeypatch):
    rng = random.Random(13)
    words = ["Rechtsschutzversicherungsgesellschaften", "internationalization", "path/to/some/other/folder/of/files",
             "camelCaseIdentifierForTheFactory", "4316522678525456", "snake_case_name_of_a_function", "antidisestablishmentarianism"]
    keys = [drawn(rng, rng.randrange(40, 65)) for _ in range(60)]
    rows = [(i, f"{rng.choice(words)} {rng.choice(words)} x {k} {rng.choice(words)}") for i, k in enumerate(keys)]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(30))) for i in range(60)]
    got = result(spark, monkeypatch, rows)
    assert got == expected(rows)
    texts, found = dict(rows), {i: [s.split(":") for s in spans.split(",") if s] for i, *_, spans in got}
    right = sum([texts[i][int(a):int(b)] for _, a, b in s] == [keys[i]] for i, s in found.items() if i < 100)
    assert right >= 55 and not any(s for i, s in found.items() if i >= 100)


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(6)
    key = drawn(rng, 64)
    rows = [(1, None), (2, ""), (3, "x" * 200_000), (4, f"token={key}"), (5, f"é {key} é"), (5, f"é {key} é"), (None, key), (None, None),
            (6, f"{key} password=abcdef " * 500), (7, "AKIA" + "Z" * 20 + "f" * 30), (8, "a" * 24), (9, "\x00 \U0001f600 token:abcdef")]
    assert result(spark, monkeypatch, rows, ", spans int") == expected(rows)
    assert result(spark, monkeypatch, []) == []
