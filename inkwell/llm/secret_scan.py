"""Operator 13: secrets by known forms, and tokens that look drawn at random.

Known forms are patterns: an assignment to a name like a password's, an access key's prefix, a long hexadecimal
number. Beyond them, every token of ``SHORTEST`` characters or more takes a battery of tests. Its encoding is
inferred: the smallest alphabet that holds all its characters. Numbers of digits alone have none. Three tests ask
whether its characters were drawn at random from that alphabet: chi-squared for equal shares (both tails: what
is too even fails as well), runs of neighbours in the same half of the alphabet, and the correlation of each
character with the next. A token is left alone if three times the least of the three p-values is below ``REJECT``.

What passes may still be a word: a short one can't fail. So a second p-value asks how often ordinary text of
that length, whose characters are alike as often as ``ALIKE`` says, would look as even. The threshold on it holds
the false discoveries at ``FALSE``: Benjamini and Hochberg's procedure over the tokens of all documents, in
classes of length (powers of two), so that many short tokens don't decide for the long ones. The p-values are counted
in bins of a tenth of a power of ten, a bounded table, and a bin counts as its upper end.

A token that lies in or over a span of a known form is not named again. Null or empty text has no spans. Repeated
rows are all returned and counted, a null doc_id stays null, an empty table gives no rows, and only doc_id and text
are read. Texts are scanned whole; places are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from math import erfc, log10, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import map_batches, stored, text_rows
from inkwell.llm.registry import query
from inkwell.sources.tables import read_table

# The known forms, each with the least length of its group 1.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("(AKIA[A-Z0-9]+)")
_HEX = re.compile("([0-9a-f]{24,})")
FORMS = (("assign", _ASSIGN, 6), ("access", _ACCESS, 20), ("hex", _HEX, 24))
#: A text without any of these, in lower case, holds no assignment.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: The shortest token that is tested, the significance of the battery, and the share of false discoveries.
SHORTEST, REJECT, FALSE = 16, 0.001, 0.01
#: Bins of p-values: tenths of a power of ten, up to this many.
BINS = 3000
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % SHORTEST)

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets from the smallest to the largest. The first that holds a token is its encoding.
ALPHABETS = {"hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "letters": _LOWER, "LETTERS": _UPPER,
             "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER,
             "Letters": _UPPER + _LOWER, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_"}
#: The chance that two characters of ordinary text in an alphabet are alike, somewhat below what is usual: 0.066 and
#: more for letters of European languages, a tenth for digits, and between for names that mix them.
ALIKE = dict.fromkeys(ALPHABETS, 0.045) | dict.fromkeys(("letters", "LETTERS", "Letters"), 0.06) | {"hex": 0.1, "HEX": 0.1}
_HOLDS = [(name, re.compile(f"[{re.escape(a)}]+").fullmatch, {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS.items()]


def normal_tail(z: float) -> float:
    """The chance that a standard normal variable exceeds ``z``."""
    return erfc(z / sqrt(2)) / 2


def chi2_z(x: float, df: float) -> float:
    """Wilson and Hilferty: the standard normal score of a chi-squared variable with ``df`` degrees of freedom."""
    return ((max(x, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df))


def encoding(token: str) -> tuple[str, dict] | None:
    """The name of the smallest alphabet that holds ``token``, and the characters' places in it."""
    if token.isdigit():
        return None
    return next(((name, places) for name, holds, places in _HOLDS if holds(token)), None)


def statistics(values: np.ndarray, k: int) -> tuple[float, float, float]:
    """(chi-squared, score of the runs, score of the serial correlation) of places in an alphabet of ``k``."""
    n = len(values)
    counts = np.bincount(values, minlength=k)
    chi2 = float((counts * counts).sum()) * k / n - n
    high = values >= k // 2
    # With neighbours independent, each joint is a change with the chance 2pq.
    p = 1 - (k // 2) / k
    change = 2 * p * (1 - p)
    joints, changes = n - 1, int((high[1:] != high[:-1]).sum())
    # Neighbouring joints share a character: their covariance is pq(1 - 4pq).
    spread = joints * change * (1 - change) + 2 * (joints - 1) * (p * (1 - p) - change * change)
    runs = (changes - joints * change) / sqrt(spread)
    x = values - (k - 1) / 2
    serial = float((x[1:] * x[:-1]).sum()) / ((k * k - 1) / 12) / sqrt(joints)
    return chi2, runs, serial


def battery(token: str) -> tuple[str, float, float] | None:
    """(encoding, p-value of being drawn at random, p-value of being ordinary text), None without an encoding."""
    found = encoding(token)
    if found is None:
        return None
    name, places = found
    n, k = len(token), len(places)
    chi2, runs, serial = statistics(np.fromiter(map(places.__getitem__, token), dtype=np.int64, count=n), k)
    drawn = min(1.0, 3 * min(2 * normal_tail(abs(z)) for z in (chi2_z(chi2, k - 1), runs, serial)))
    # Characters that are alike more often than equal shares make them give a non-central chi-squared;
    # Patnaik's approximation has its mean and variance.
    off = n * (k * ALIKE[name] - 1)
    ratio = (k - 1 + 2 * off) / (k - 1 + off)
    return name, drawn, normal_tail(-chi2_z(chi2 / ratio, (k - 1 + off) / ratio))


def known(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the known forms, leftmost and without overlap within a kind."""
    out = []
    for kind, form, least in FORMS:
        if kind == "assign":
            lower = text.lower()
            if not any(name in lower for name in NAMES):
                continue
        out += [(kind, m.start(), m.end()) for m in form.finditer(text) if len(m[1]) >= least]
    return out


def tested(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, bin) of the tokens outside ``spans`` that have an encoding: the bin of the p-value of being
    ordinary text, 0 for those that the battery rejects."""
    starts, ends = [], []  # the spans as stretches apart from one another
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        i = bisect_right(ends, a)
        if (i == len(ends) or starts[i] >= b) and (found := battery(m[0])) is not None:
            _, drawn, p = found
            yield a, b, 0 if drawn < REJECT else min(BINS, int(-10 * log10(p))) if p > 0 else BINS


def thresholds(spans: DataFrame) -> dict[int, int]:
    """For each class of length the least bin whose p-values pass Benjamini and Hochberg's procedure over all ``spans``
    (size, bin). At most BINS rows a class are ranked, and one row a class reaches the driver."""
    counts = spans.groupBy("size", "bin").agg(F.count("*").alias("n"))
    size = Window.partitionBy("size")
    ranked = counts.select("size", "bin", F.sum("n").over(size).alias("m"), F.sum("n").over(size.orderBy(F.desc("bin"))).alias("rank"))
    good = F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("m") <= FALSE * F.col("rank")
    return {r["size"]: r["bin"] for r in ranked.where(good).groupBy("size").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every document's spans (kind, start, end) by start, then kind."""

    def batch(d: dict) -> dict:
        found = []
        for t in d["text"]:
            base = known(t)
            spans = [(a, KINDS.index(kind), b, 0, 0) for kind, a, b in base]
            spans += [(a, 3, b, (b - a).bit_length(), p) for a, b, p in tested(t, base)]
            found.append([dict(zip(("start", "kind", "end", "size", "bin"), s)) for s in sorted(spans)])
        return {"doc_id": d["doc_id"], "spans": found}

    # Spans without texts are written; the thresholds need them all before any is judged.
    rows = stored(map_batches(text_rows(docs), batch,
                              "doc_id long, spans array<struct<start: long, kind: int, end: long, size: int, bin: int>>"), "spans")
    least = thresholds(rows.select(F.explode("spans").alias("s")).select("s.*").where("kind = 3"))

    def passes(s: Column) -> Column:
        found = s["kind"] < 3
        for size, low in sorted(least.items()):
            found = found | ((s["size"] == size) & (s["bin"] >= low))
        return found

    kinds = F.array(*map(F.lit, KINDS))
    return rows.select("doc_id", F.transform(F.filter("spans", passes), lambda s: F.struct(
        F.element_at(kinds, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


@query("op13_secret_scan")
def op13_secret_scan(spark, sf_dir):
    """The spans of secrets in every text of documents."""
    found = scan(read_table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined("spans").alias("spans"))
