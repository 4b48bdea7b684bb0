"""DuckDB spellings of the column helpers, for oracle SQL only."""

from __future__ import annotations

from inkwell.functions.text import TRACKING_PARAMS

SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*://"


def source_key(x: str) -> str:
    return f"replace(regexp_replace(lower({x}), '^\\s+|\\s+$', '', 'g'), ' ', '_')"


def host(x: str) -> str:
    return f"regexp_replace(lower(regexp_extract({x}, '{SCHEME}([^/?#:]+)', 1)), '^www\\.', '')"


def url_rest(x: str) -> str:
    return f"regexp_extract({x}, '{SCHEME}[^/?#]*([^#]*)', 1)"


def canonical_url(x: str) -> str:
    rest = url_rest(x)
    path = f"regexp_replace(regexp_extract({rest}, '^([^?]*)', 1), '/+$', '')"
    query = f"regexp_extract({rest}, '\\?(.*)$', 1)"
    tracked = ", ".join(f"'{p}'" for p in TRACKING_PARAMS)
    params = (f"list_filter(string_split({query}, '&'), lambda p: p <> '' AND "
              f"split_part(p, '=', 1) NOT IN ({tracked}))")
    return (f"('https://' || {host(x)} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
            f"CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END)")


def word_count(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {t} = '' THEN 0 ELSE len(regexp_split_to_array({t}, '\\s+')) END"


def clean_text(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def md5_bucket(x: str, mod: int) -> str:
    return f"(CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT) % {mod})"


def tokens(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda w: w <> '')")


def html_to_text(x: str) -> str:
    from inkwell.functions.html import ARTICLE_BLOCK, BODY_BLOCK, DROP_BLOCKS, ENTITIES, TAG
    s = x
    for p in DROP_BLOCKS:
        s = f"regexp_replace({s}, '{_q(p)}', ' ', 'g')"
    blk = (f"CASE WHEN regexp_matches({s}, '(?i)<article[\\s>]') THEN regexp_extract({s}, '{_q(ARTICLE_BLOCK)}', 1) "
           f"WHEN regexp_matches({s}, '(?i)<body[\\s>]') THEN regexp_extract({s}, '{_q(BODY_BLOCK)}', 1) ELSE {s} END")
    t = f"regexp_replace({blk}, '{_q(TAG)}', ' ', 'g')"
    for ent, ch in ENTITIES:
        t = f"replace({t}, '{_q(ent)}', '{_q(ch)}')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _q_lit(s: str) -> str:
    return "'" + _q(s) + "'"
