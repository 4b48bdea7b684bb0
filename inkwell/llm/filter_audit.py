"""Operator 11: how filters interact, over every order in which they could run.

A filter is a letter with a condition on a row. One more, the duplicate filter, fails a row whose whole text
another row with a smaller doc_id has: an existential self-join, left-semi on hash, exact text and smaller
doc_id, whose right side is first reduced to the smallest doc_id of each text. Texts whose hash is alone stay out. The ids that it finds are united with the ids that
the other conditions fail and summed to one bit pattern a row; rows are counted by part, pattern and labels.
There are at most ``2 ** n`` patterns a part, and all orders are played on those counts, not on rows: before a
step come the bits of the filters to its left, so what a step removes, keeps or finds already removed is a
question to the pattern alone. A row that fails k filters is removed by each of them in ``n! / k`` orders.

Null text counts as empty, a null part as the empty string. A null doc_id is neither a duplicate nor makes one,
and has no labels. Repeated rows are all counted; of equal texts all rows with the smallest doc_id pass the
duplicate filter. A doc_id labelled more than once has a label if any of its rows has it. An empty table gives no
rows. Texts are read whole. Only doc_id, text and the part's column are read, and doc_id and the labels' columns.
A text that a third of all rows share is split over tasks: on the right side it is one row, put together where its
rows lie; on the left side its rows are dealt by a salt as well, and its one row is given to each salt.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import text_rows
from inkwell.llm.registry import query
from inkwell.sources.tables import read_table

#: White space that splits words, for Spark and for DuckDB.
SPACE = r"[\x20\x09-\x0D]+"
#: A hash that more than one row in so many has is dealt by salts; there are fewer such hashes than this.
SLICES = 1024


def words(text: Column) -> Column:
    """The words of ``text``: all that lies between white space."""
    return F.array_remove(F.split(text, SPACE), "")


def quality_bits(docs: DataFrame) -> DataFrame:
    """``docs`` with ``bits``: 1 for few words, 2 for repeated words, 4 for capitals, 8 for marks."""
    w = docs.withColumn("__words", words(F.col("text")))
    n, distinct = F.size("__words"), F.size(F.array_distinct("__words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    conditions = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length("text"),
                  F.col("text").rlike("[#$%&*|]")]
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))
    return w.withColumn("bits", bits).drop("__words")


def later_copies(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, hash) of ``docs`` (doc_id, text) whose text a row with a smaller doc_id has."""
    rows = docs.where(F.col("doc_id").isNotNull()).withColumn("hash", F.xxhash64("text"))
    total = docs.count()
    counts = rows.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    many = F.col("n") * SLICES > total
    counts = counts.select("hash", many.alias("many"), F.when(many, F.ceil(F.col("n") * SLICES / max(1, total)))
                           .otherwise(1).cast("int").alias("slices"))
    hot = F.broadcast(counts.where("many").select("hash", "slices"))  # fewer than SLICES rows of two numbers
    each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1)).alias("slice")
    dealt = rows.join(hot, "hash", "left").withColumn(
        "slice", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"), F.lit(0))).drop("slices")
    # Texts are shuffled once, here, at any size; only those whose hash occurs again go on. Hashes grow with the rows: a
    # broadcast of them would hold for small tables alone.
    left = dealt.join(counts.select("hash", each).hint("merge"), ["hash", "slice"], "left_semi")
    first = left.groupBy("hash", "text").agg(F.min("doc_id").alias("first"))
    right = first.join(hot, "hash", "left").select("hash", "text", "first", each)
    dealt_alike = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("hash", "slice")]
    # Equality as two bounds is no join key: the left side stays dealt as it is.
    same = (F.col("l.text") >= F.col("r.text")) & (F.col("l.text") <= F.col("r.text"))
    return left.alias("l").join(right.alias("r"), [*dealt_alike, same & (F.col("r.first") < F.col("l.doc_id"))], "left_semi")


def combinations(docs: DataFrame, labels: DataFrame, part: str = "lang", duplicate: int = 16) -> DataFrame:
    """(part, bits, good, toxic, n): the rows of each part by the filters that they fail and by label."""
    rows = text_rows(docs, F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    # A row is named by its id and its text's hash; repeated rows share a name and are counted by part.
    failing = quality_bits(rows).groupBy("doc_id", F.xxhash64("text").alias("hash"), "part").agg(
        F.max("bits").alias("bits"), F.count("*").alias("n"))
    own = F.struct("part", "bits", "n")
    failing = failing.select("doc_id", "hash", own.alias("own"), F.lit(0).alias("more"))
    nothing = F.lit(None).cast(failing.schema["own"].dataType).alias("own")
    copies = later_copies(rows.select("doc_id", "text")).select("doc_id", "hash", nothing, F.lit(duplicate).alias("more"))
    # A name's list has one entry for each part that it occurs in.
    united = failing.unionByName(copies).groupBy("doc_id", "hash").agg(F.bit_or("more").alias("more"), F.collect_list("own").alias("own"))
    patterns = united.select("doc_id", "more", F.explode("own").alias("own")).select(
        "doc_id", "own.part", F.col("own.bits").bitwiseOR(F.col("more")).alias("bits"), "own.n")
    # A doc_id that many rows have is a few rows before it meets its labels.
    patterns = patterns.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    labelled = patterns.join(known, "doc_id", "left")
    good, toxic = (F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic"))
    return labelled.groupBy("part", "bits", good, toxic).agg(F.sum("n").alias("n"))


def interactions(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of ``letters`` and step; letter i stands for bit i of the patterns."""
    orders = F.array(*map(F.lit, map("".join, permutations(letters))))
    fails = F.concat(*(F.when(F.col("bits").bitwiseAND(1 << i) != 0, c).otherwise("") for i, c in enumerate(letters)))
    each = counts.select("*", fails.alias("fails"), F.explode(orders).alias("filter_order"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    own, before = F.expr("substring(filter_order, step, 1)"), F.expr("left(filter_order, step - 1)")
    each = each.withColumns({"own": own, "before": before})
    own, before = F.col("fails").contains(F.col("own")), F.expr("translate(before, fails, '') <> before")
    removed = own & ~before
    # Of the n! orders, one in k has a given one of k failed filters before the others.
    share = F.lit(factorial(len(letters))) / F.length("fails")

    def total(condition: Column, name: str, value: Column = F.col("n")) -> Column:
        return F.sum(F.when(condition, value).otherwise(0)).cast("long").alias(name)

    return each.groupBy("part", "filter_order", "step").agg(
        total(~own & ~before, "kept"), total(removed, "removed"), total(own & before, "redundant"),
        total(F.col("fails") == F.col("own"), "unique_fails"), total(removed & F.col("good"), "good_lost"),
        total(removed & F.col("toxic"), "toxic_lost"), total(own, "shapley", F.col("n") * share))


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, part, text, min(doc_id) OVER (PARTITION BY text) AS first_id,
  regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
lab AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
  || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN first_id < f.doc_id THEN 'E' ELSE '' END AS fails
  FROM f LEFT JOIN lab ON lab.doc_id = f.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders(o) AS (SELECT '' UNION ALL SELECT o || x FROM orders, letters WHERE length(o) < 5 AND NOT contains(o, x)),
steps AS (SELECT o AS filter_order, CAST(i AS INT) AS step, substr(o, CAST(i AS INT), 1) AS own,
  '[' || CASE WHEN i = 1 THEN '-' ELSE substr(o, 1, CAST(i - 1 AS INT)) END || ']' AS before FROM orders, range(1, 6) r(i) WHERE length(o) = 5),
e AS (SELECT part, filter_order, step, own, good, toxic, n, fails, contains(fails, own) AS here,
  regexp_matches(fails, before) AS earlier FROM c, steps),
a AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN here AND NOT earlier AND good THEN n ELSE 0 END) AS good_lost,
  sum(CASE WHEN here AND NOT earlier AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM e GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a
"""


@query("op11_filter_audit", SQL)
def op11_filter_audit(spark, sf_dir):
    """Five filters over documents: per language, order and step what each removes, and its share over all orders."""
    return interactions(combinations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))
