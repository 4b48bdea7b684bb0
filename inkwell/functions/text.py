"""Column-level text helpers (all JVM built-ins, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: drop leading/trailing whitespace of any kind."""
    return F.regexp_replace(col_of(c), r"^\s+|\s+$", "")


def source_key(c) -> Column:
    """A3: lower, then strip, then each single space -> '_' (runs keep several '_')."""
    return F.replace(strip_ws(F.lower(col_of(c))), F.lit(" "), F.lit("_"))


def clean_text(c) -> Column:
    """Collapse every whitespace run to one space, trim the ends."""
    return F.trim(F.regexp_replace(col_of(c), r"\s+", " "))


def word_count(c) -> Column:
    """Words separated by whitespace; empty or null text counts 0."""
    t = strip_ws(F.coalesce(col_of(c), F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def tokens(c) -> Column:
    """Lower-cased word tokens (letters/digits, Unicode aware), empties removed."""
    arr = F.split(F.lower(F.coalesce(col_of(c), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(arr, lambda x: x != "")


def host_of(url) -> Column:
    """Lower-cased host of a URL, without port and leading 'www.'."""
    h = F.lower(F.regexp_extract(col_of(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    return F.regexp_replace(h, r"^www\.", "")


# Query parameters that only track campaigns/referrers.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
                   "ref", "fbclid", "gclid")


def canonical_url(url) -> Column:
    """Canonical form used as the article key.

    Lower-case scheme and host, scheme forced to https, 'www.' dropped, fragment
    dropped, tracking parameters dropped (others kept in their order), trailing
    slash dropped from a non-root path.
    """
    u = col_of(url)
    host = host_of(u)
    rest = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    path = F.regexp_replace(path, r"/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    params = F.filter(F.split(query, "&"),
                      lambda p: (p != "") & ~F.split(p, "=").getItem(0).isin(*TRACKING_PARAMS))
    q = F.array_join(params, "&")
    return F.concat(F.lit("https://"), host, path,
                    F.when(F.size(params) > 0, F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def md5_bucket(c, mod: int) -> Column:
    """Stable bucket in [0, mod) from the first 32 bits of md5 (same in DuckDB)."""
    return F.pmod(F.conv(F.substring(F.md5(col_of(c)), 1, 8), 16, 10).cast("bigint"), F.lit(mod))


#: Characters of text in a partition of ``dealt_by_id``; its tokens take some forty times as much memory.
DEALT_CHARS = 4 << 20


def dealt_by_id(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, text) of ``df`` with a row's id, shuffled once, by id, into partitions of about ``DEALT_CHARS`` characters, so that what is
    counted per id and token, sentence or the like after it is not shuffled again. The number of partitions is fixed by
    the text's length: AQE would join some to 64 MB of compressed text.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(id_col, text)
    total = rows.agg(F.sum(F.length(text))).first()[0] or 0
    return rows.repartition(int(min(20_000, total // DEALT_CHARS + 1)), id_col)
