"""Deletion along declared keys (K2): rows that refer to a deleted row go with it, or lose the reference.

The keys form a graph of tables; tables are worked off parents first, so each table's deleted ids are known, and
written, before its children are looked at. A key from a table to itself is followed by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import cut_lineage

CASCADE, SET_NULL = "cascade", "set null"
#: Null references are spread over this many places of a join.
SALTS = 1024


@dataclass(frozen=True)
class Key:
    """``child.column`` refers to the primary key of ``parent``; ``rule`` says what a deleted parent does to the row."""

    child: str
    column: str
    parent: str
    rule: str = CASCADE


#: The keys of the schema. A snap belongs to a story, interactions and comments to a user and a snap.
KEYS = (
    Key("user_preferences", "user_id", "users"),
    Key("articles", "source_id", "sources", SET_NULL),
    Key("articles", "story_id", "stories", SET_NULL),
    Key("snaps", "story_id", "stories"),
    Key("interactions", "user_id", "users"),
    Key("interactions", "snap_id", "snaps"),
    Key("comments", "user_id", "users"),
    Key("comments", "snap_id", "snaps"),
    Key("comments", "parent_id", "comments"),
    Key("notifications", "user_id", "users"),
)


def parents_first(names: Iterable[str], keys: Iterable[Key]) -> list[str]:
    """The tables so that each comes after those it refers to. Keys that go round several tables raise CycleError."""
    names = list(names)
    before = {n: {k.parent for k in keys if k.child == n and k.parent != n and k.parent in names} for n in names}
    return list(TopologicalSorter(before).static_order())


def with_descendants(gone: DataFrame, rows: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """``gone`` and all rows below them. Every row looks twice as far up in each round, so a chain of n rows takes
    about log2(n) checkpointed rounds. Rows in a cycle go when one of the cycle does."""
    dead = gone.select(id_col).distinct().withColumn("dead", F.lit(True))
    s = (rows.select(id_col, F.col(parent_col).alias("up")).where(F.col(id_col).isNotNull())
         .join(dead, id_col, "left").withColumn("dead", F.coalesce("dead", F.lit(False))))
    s = cut_lineage(s.withColumn("up", F.when(~F.col("dead"), F.col("up"))))
    waiting, fell, reach = s.where("up IS NOT NULL").count(), True, 1
    while waiting and (fell or reach < waiting):
        above = s.select(F.col(id_col).alias("up"), F.col("up").alias("_up"), F.col("dead").alias("_dead"))
        # A parent that is not there ends the way up.
        moved = s.where("up IS NOT NULL").join(above, "up", "left").select(
            id_col, F.when(~F.coalesce("_dead", F.lit(False)), F.col("_up")).alias("up"), F.coalesce("_dead", F.lit(False)).alias("dead"))
        s = cut_lineage(s.where("up IS NULL").unionByName(moved))
        left = s.where("up IS NOT NULL").count()
        waiting, fell, reach = left, left < waiting, reach * 2
    return s.where("dead").select(id_col).unionByName(gone.select(id_col)).distinct()


def _marked(rows: DataFrame, column: str, gone: DataFrame, mark: str) -> DataFrame:
    """``rows`` with a boolean ``mark``: does ``column`` name a deleted row? Null references are spread."""
    salt = F.when(F.col(column).isNull(), F.floor(F.rand(7) * SALTS).cast("int")).otherwise(F.lit(-1))
    dead = gone.toDF(column).select(column, F.lit(-1).alias("_salt"), F.lit(True).alias(mark))
    return (rows.withColumn("_salt", salt).join(dead, [column, "_salt"], "left")
            .withColumn(mark, F.coalesce(mark, F.lit(False))).drop("_salt"))


@dataclass(frozen=True)
class Purged:
    """A table after a deletion: its rows (``before``), the deleted ids, and the rows left with ``nulled`` references."""

    before: DataFrame
    gone: DataFrame
    marked: DataFrame
    nulled: tuple[str, ...]

    @property
    def kept(self) -> DataFrame:
        out = self.marked
        for c in self.nulled:
            out = out.withColumn(c, F.when(~F.col(f"_gone_{c}"), F.col(c)))
        return out.select(*self.before.columns)


def cascade(tables: dict[str, DataFrame], ids: dict[str, str], doomed: dict[str, DataFrame],
            keys: Iterable[Key] = KEYS) -> dict[str, Purged]:
    """K2: delete the rows whose ids are in ``doomed`` (one column a table) and follow the keys.

    ``ids`` names the primary key of each table. Keys to or from tables that aren't given are skipped. A row that both
    loses a reference and is deleted by another key is deleted. A reference to a row that never existed stays as it is;
    a null reference follows nothing. Only ids are shuffled to find out what goes, and they are written once a table.
    """
    keys = [k for k in keys if k.child in tables and k.parent in tables]
    out: dict[str, Purged] = {}
    for name in parents_first(tables, keys):
        rows, pk = tables[name], ids[name]
        mine = [k for k in keys if k.child == name]
        found = [doomed[name].toDF(pk)] if name in doomed else []
        found += [rows.select(pk, k.column).join(out[k.parent].gone.toDF(k.column), k.column, "left_semi").select(pk)
                  for k in mine if k.rule == CASCADE and k.parent != name]
        gone = reduce(DataFrame.unionByName, found) if found else rows.select(pk).where(F.lit(False))
        # Only rows that are there can be deleted.
        gone = cut_lineage(rows.select(pk).join(gone.where(F.col(pk).isNotNull()), pk, "left_semi").distinct())
        for k in mine:
            if k.parent == name and k.rule == CASCADE:
                gone = cut_lineage(with_descendants(gone, rows, pk, k.column))
        marked, nulled = rows.join(gone, pk, "left_anti"), []
        for k in mine:
            if k.rule == SET_NULL:
                marked = _marked(marked, k.column, gone if k.parent == name else out[k.parent].gone, f"_gone_{k.column}")
                nulled.append(k.column)
        out[name] = Purged(rows, gone, marked, tuple(nulled))
    return out


def cascade_report(purged: dict[str, Purged]) -> DataFrame:
    """Per table: rows before, kept and purged, and references set to null in rows that stay."""
    parts = []
    for name, p in purged.items():
        nulled = reduce(lambda a, b: a + b, [F.count_if(F.col(f"_gone_{c}")) for c in p.nulled], F.lit(0))
        kept = p.marked.agg(F.count("*").alias("kept"), nulled.cast("bigint").alias("nulled"))
        before = p.before.agg(F.count("*").alias("before"))
        parts.append(before.join(kept).select(  # one row each
            F.lit(name).alias("table_name"), "before", "kept", (F.col("before") - F.col("kept")).alias("purged"), "nulled"))
    return reduce(DataFrame.unionByName, parts)
