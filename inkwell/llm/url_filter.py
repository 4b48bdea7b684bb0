"""Operator 8: URL filter with pattern rules indexed by their rarest literal token.

Every rule is a regular expression over host + path. Its literal tokens (runs of a-z0-9 that any
match must hold whole) are counted over all URLs, and the rule is filed under the rarest of them.
A URL's own tokens fetch the rules filed there; only those run their expression. Rules without a
literal token are fetched by every URL.

A site rule ``host/path`` fits its host and all subdomains where the path starts with the rule's
path; the longest fitting site rule gives the verdict (of equal length: block before allow, then
text order). Where none fits, a URL that fits any pattern rule is blocked, any other is allowed.

Null URLs and URLs without ``://`` have empty host and path and are judged like any other. Repeated
rows are all returned. An empty table gives no rows; an empty rule list allows everything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.registry import query
from inkwell.sources.tables import read_table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query's contract.
SITE_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
              ("block", "net/es/"), ("block", "net/fr/"))

#: Words that, as a whole part of a host name, mark a site as unwanted.
UNWANTED = ("spam", "pills", "adult", "casino", "porn", "xxx", "warez", "viagra", "escort", "phishing", "malware")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``tokens`` are the literals that a match must hold whole."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool = False


def site_rule(action: str, rule: str) -> Rule:
    """A rule like ``example.com/en/``; its last token counts only if a delimiter ends it."""
    tokens = re.findall("[a-z0-9]+", rule.translate(str.maketrans(_UPPER, _LOWER)))
    if tokens and re.search("[A-Za-z0-9]$", rule) and "/" in rule:
        tokens = tokens[:-1]
    quoted = "".join(c if re.match("[A-Za-z0-9/]", c) else f"\\x{{{ord(c):x}}}" for c in rule)
    return Rule(rule, action, f"^(?:[^/]*\\.)?{quoted}", tuple(tokens), True)


def host_word_rule(word: str) -> Rule:
    return Rule(word, "block", f"^(?:[^/]*[^a-z0-9/])?{word}(?![a-z0-9])", (word,))


RULES = tuple(site_rule(*r) for r in SITE_RULES) + tuple(host_word_rule(w) for w in UNWANTED)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as the module says; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    return (_ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def url_tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_ascii_lower(key), "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(keys: DataFrame, rules: tuple[Rule, ...]) -> dict[str | None, list[int]]:
    """Rule numbers by their rarest literal token over all ``keys`` (column key); None: no literal.

    The counts are pre-aggregated; the driver gets one count for each token of the rules.
    """
    literals = sorted({t for r in rules for t in r.tokens})
    seen = {}
    if literals:
        seen = {r["t"]: r["n"] for r in keys.select(F.explode(url_tokens(F.col("key"))).alias("t"))
                .where(F.col("t").isin(literals)).groupBy("t").agg(F.count("*").alias("n")).collect()}
    index: dict[str | None, list[int]] = {}
    for i, r in enumerate(rules):
        token = min(r.tokens, key=lambda t: (seen.get(t, 0), -len(t), t)) if r.tokens else None
        index.setdefault(token, []).append(i)
    return index


def _order(rules: tuple[Rule, ...]) -> list[int]:
    """Rank of each rule: site rules before patterns, longer first, block before allow, then by text."""
    best = sorted(range(len(rules)), key=lambda i: (not rules[i].site, -len(rules[i].name),
                                                    rules[i].action != "block", rules[i].name))
    return [best.index(i) for i in range(len(rules))]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, inline: int = 256) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern_rule) for each row of ``pages`` (page_id, url).

    Up to ``inline`` rules the index is a literal of the plan: one scan, no shuffle. Beyond, the
    distinct host + path keys are joined with the index on the token.
    """
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", F.concat("host", "path"))
    if not rules:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("pattern_rule"))
    index, rank = rule_index(base, rules), _order(rules)
    best = (_fetch_inline if len(rules) <= inline else _fetch_joined)(base, rules, index, rank)
    rule = F.when(F.col("best.site"), F.col("best.name"))
    return best.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(F.col("best.action"), F.lit("allow")).alias("verdict"),
        F.when(~F.col("best.site"), F.col("best.name")).alias("pattern_rule"))


def _fetch_inline(base: DataFrame, rules, index, rank) -> DataFrame:
    def lit_rule(i: int) -> Column:
        r = rules[i]
        return F.struct(F.lit(rank[i]).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"),
                        F.lit(r.site).alias("site"), F.lit(r.pattern).alias("pattern"))

    filed = F.create_map(*[x for t, ids in index.items() if t is not None
                           for x in (F.lit(t), F.array(*map(lit_rule, ids)))]) if set(index) - {None} else None
    parts = [F.array(*map(lit_rule, index[None]))] if None in index else []
    if filed is not None:
        known = [t for t in index if t is not None]
        own = F.filter(F.col("tokens"), lambda t: t.isin(known))
        parts.append(F.flatten(F.transform(own, lambda t: F.element_at(filed, t))))
    fits = F.filter(F.concat(*parts), lambda r: F.rlike(F.col("key"), r["pattern"]))
    return base.withColumn("tokens", url_tokens(F.col("key"))).withColumn("best", F.array_min(fits))


def _fetch_joined(base: DataFrame, rules, index, rank) -> DataFrame:
    spark = base.sparkSession
    rows = [(t, rank[i], rules[i].name, rules[i].action, rules[i].site, rules[i].pattern)
            for t, ids in index.items() for i in ids]
    table = spark.createDataFrame(rows, "token string, rank int, name string, action string, site boolean, pattern string")
    keys = base.select("key").distinct()
    # A null token stands for the rules without a literal.
    tokens = keys.select("key", F.explode(F.concat(url_tokens(F.col("key")), F.array(F.lit(None).cast("string")))).alias("t"))
    fits = (tokens.join(table, tokens.t.eqNullSafe(table.token))
            .where(F.rlike(F.col("key"), F.col("pattern")))
            .groupBy("key").agg(F.min(F.struct("rank", "name", "action", "site")).alias("best")))
    return base.join(fits, "key", "left")


_BAD = "|".join(UNWANTED)
SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
w AS (SELECT *, list_filter(string_split_regex(host, '[^a-z0-9]+'), lambda t: regexp_full_match(t, '{_BAD}')) AS bads FROM j)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN len(bads) > 0 THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL AND len(bads) > 0 THEN list_extract(list_sort(list_transform(bads, lambda t: lpad(CAST(1000 - length(t) AS VARCHAR), 4, '0') || t)), 1)[5:] END
    AS pattern_rule
FROM w
"""


@query("op8_url_filter", SQL)
def op8_url_filter(spark, sf_dir):
    """The contract's rules over every page url."""
    return judge(read_table(spark, sf_dir, "pages"))
