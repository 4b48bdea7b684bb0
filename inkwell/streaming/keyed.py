"""Structured Streaming jobs with state of their own (L5, L6): ``transformWithState``.

State lies in RocksDB under the query's checkpoint, keyed as the data is grouped, so it moves with its
partition when an executor is lost. Rows come to a processor one by one, in Arrow batches of many keys; no job holds a
key's rows longer than it takes to read them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import datetime, time, timedelta, timezone
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What an action makes of a toggle.
TOGGLES = {"like": ("like", True), "unlike": ("like", False),
           "bookmark": ("bookmark", True), "unbookmark": ("bookmark", False)}
COUNTED = ("read", "comment", "share")


def keyed_session(spark: SparkSession) -> SparkSession:
    """A session of its own that keeps state in RocksDB; the caller's settings stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def _order(event: tuple) -> tuple:
    """The order of events (microseconds, event_id, ...); nulls come first."""
    return event[0] is not None, event[0], event[1] is not None, event[1]


#: Keys share the state's calls by a hash: a call takes as long as some hundred rows do. The number is part of a checkpoint.
SLOTS = 1 << 13


class LiveState(StatefulProcessor):
    """Key ``slot``, a hash of (user_id, item_id), the pairs of which are its members. State holds a row a pair, column by column: how
    often it changed (``version``) and the last action of like and bookmark. Each batch gives one row of differences a pair
    that it touches, so a sum over an item's rows is its live count. A slot's state is read and written once a batch."""

    OUT = ("user_id long, item_id long, version long, reads long, comments long, shares long, likes long, bookmarks long, "
           "like_active boolean, like_us long, bookmark_active boolean, bookmark_us long")
    IN = ("user_id", "item_id", "event_id", "us", "interaction_type", "action")
    _ROW = Row(*(c.split()[0] for c in OUT.split(", ")))

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One value: each call to the state store is a round trip a key.
        one = "{0}_active array<boolean>, {0}_us array<long>, {0}_event array<long>"
        columns = ["user_id array<long>", "item_id array<long>", "version array<long>", *map(one.format, ("like", "bookmark"))]
        self.state = handle.getValueState("state", ", ".join(columns))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        counts, last, take = {}, {}, None
        for row in rows:
            take = take or itemgetter(*map(row.__fields__.index, self.IN))
            user, item, event_id, us, what, action = take(row)
            pair = user, item
            mine = counts.get(pair)
            if mine is None:
                mine = counts[pair] = dict.fromkeys(COUNTED, 0)
            if what in mine:
                mine[what] += 1
            if action in TOGGLES:
                kind, active = TOGGLES[action]
                event = us, event_id, active
                last[pair, kind] = max(last.get((pair, kind), event), event, key=_order)
        stored = {(x[0], x[1]): x[2:] for x in zip(*(self.state.get() or ()))}
        out = []
        for pair, mine in counts.items():
            version, *toggles = stored.get(pair, (0, None, None, None, None, None, None))
            change, now = {}, {}
            for kind, (active, us, event_id) in (("like", toggles[:3]), ("bookmark", toggles[3:])):
                new = last.get((pair, kind))
                if new is None or (active is not None and _order(new) <= _order((us, event_id))):
                    new = us, event_id, active
                change[kind] = int(bool(new[2])) - int(bool(active))
                now[kind] = new[2], new[0], new[1]
            stored[pair] = (version + 1, *now["like"], *now["bookmark"])
            out.append(self._ROW(*pair, version + 1, mine["read"], mine["comment"], mine["share"], change["like"], change["bookmark"],
                                 *now["like"][:2], *now["bookmark"][:2]))
        if out:
            self.state.update(tuple(map(list, zip(*((*pair, *x) for pair, x in stored.items())))))
        yield from out

    def close(self) -> None:
        pass


def stream_state(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of differences per (user, item) and batch from a stream of events (event_id, ts, user_id,
    item_id, interaction_type, action).

    An event that comes again within ``delay`` is dropped by its id; one older than the watermark is dropped as late.
    Toggles go by (ts, event_id), whatever order events come in.
    """
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    # Times are microseconds in Python, which has more than one notion of a timestamp.
    slot = F.pmod(F.xxhash64("user_id", "item_id"), F.lit(SLOTS)).alias("slot")
    changes = once.withColumn("us", F.unix_micros("ts")).select(slot, *LiveState.IN).groupBy("slot").transformWithState(
        statefulProcessor=LiveState(), outputStructType=LiveState.OUT, outputMode="Append", timeMode="None")
    for kind in ("like", "bookmark"):
        changes = changes.withColumn(f"{kind}_us", F.timestamp_micros(f"{kind}_us")).withColumnRenamed(f"{kind}_us", f"{kind}_ts")
    return changes


def live_counts(changes: DataFrame) -> DataFrame:
    """Counts per item from the differences, as F7 gives them."""
    names = ("reads", "likes", "comments", "shares", "bookmarks")
    return changes.groupBy("item_id").agg(*(F.sum(c).alias(c) for c in names)).select("item_id", *names)


def live_toggles(changes: DataFrame) -> DataFrame:
    """(user_id, item_id, kind, active, last_ts) from each key's last difference, as F6 gives them."""
    both = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_active").alias("active"), F.col(f"{k}_ts").alias("last_ts"))
                     for k in ("like", "bookmark")))
    last = changes.groupBy("user_id", "item_id").agg(F.max_by(both, "version").alias("both"))
    rows = last.select("user_id", "item_id", F.explode("both").alias("t")).select("user_id", "item_id", "t.*")
    return rows.where(F.col("active").isNotNull())


class CommentLimiter(StatefulProcessor):
    """Key (user_id, day). ``count`` is what the day has let through; a timer at the day's end clears it."""

    OUT = "user_id long, day date, event_id long, item_id long, us long, day_rank int"

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Each call to the state store is a round trip a key.
        stored = self.count.get()
        count = stored[0] if stored else 0
        # No more than the day still lets through is held.
        first = heapq.nsmallest(self.n - count, ((r.us, r.event_id, r.item_id) for r in rows), key=_order)
        if stored is None:
            end = datetime.combine(key[1], time.min, timezone.utc) + timedelta(days=1)
            self.handle.registerTimer(int(end.timestamp() * 1000))
        if first or stored is None:
            self.count.update((count + len(first),))
        for i, (us, event_id, item_id) in enumerate(first, count + 1):
            yield Row(user_id=key[0], day=key[1], event_id=event_id, item_id=item_id, us=us, day_rank=i)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_limit_comments(events: DataFrame, n: int = 100, delay: str = "1 hour") -> DataFrame:
    """The first ``n`` comments a user and day, as they come; within a batch by (ts, event_id).

    ``ts`` is a timestamp in UTC days. When the watermark passes a day's end its state is cleared, and a comment that
    comes later still is dropped as late: it can't start the day anew.
    """
    c = events.where(F.col("interaction_type") == "comment").withWatermark("ts", delay)
    some = c.withColumn("day", F.to_date("ts")).withColumn("us", F.unix_micros("ts")).groupBy("user_id", "day").transformWithState(
        statefulProcessor=CommentLimiter(n), outputStructType=CommentLimiter.OUT, outputMode="Append", timeMode="EventTime")
    return some.withColumn("us", F.timestamp_micros("us")).withColumnRenamed("us", "ts")
