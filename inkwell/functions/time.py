"""Time helpers: every time-based operator takes an explicit ``as_of``.

``as_of`` is folded to a literal on the driver (a constant, never
``current_timestamp()``), so runs are reproducible and Catalyst can push the
resulting range predicates into the parquet scan.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parse(as_of) -> datetime:
    if isinstance(as_of, datetime):
        return as_of
    return datetime.fromisoformat(str(as_of))


def ts_lit(as_of, minus: timedelta | None = None) -> Column:
    """Timestamp literal (TIMESTAMP_NTZ) for ``as_of - minus``."""
    t = _parse(as_of)
    if minus is not None:
        t = t - minus
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def in_window(ts: Column, as_of, seconds: float) -> Column:
    """Left-open, right-closed window ``(as_of - seconds, as_of]``."""
    return (ts > ts_lit(as_of, timedelta(seconds=seconds))) & (ts <= ts_lit(as_of))


def age_seconds(ts: Column, as_of) -> Column:
    """Age in whole seconds between ``ts`` and ``as_of`` (no date truncation)."""
    return F.timestamp_diff("SECOND", ts, ts_lit(as_of))


def time_ago(ts: Column, as_of) -> Column:
    """Human 'time ago' text relative to as_of."""
    s = age_seconds(ts, as_of)
    return (F.when(s < 60, F.lit("just now"))
            .when(s < 3600, F.concat((s / 60).cast("bigint").cast("string"), F.lit("m ago")))
            .when(s < 86400, F.concat((s / 3600).cast("bigint").cast("string"), F.lit("h ago")))
            .when(s < 7 * 86400, F.concat((s / 86400).cast("bigint").cast("string"), F.lit("d ago")))
            .otherwise(F.concat((s / (7 * 86400)).cast("bigint").cast("string"), F.lit("w ago"))))


def age_seconds_exact(ts: Column, as_of) -> Column:
    """Age in fractional seconds (microsecond precision) between ``ts`` and ``as_of``."""
    return F.timestamp_diff("MICROSECOND", ts, ts_lit(as_of)) / F.lit(1e6)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds from 1970-01-01 to a time without zone; no session time zone has a part in it."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
