"""Row filters. All are plain predicates, so they reach the scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import col, ne_or_null, null_if_empty
from ..functions.times import matches, ts

# Waits that only mean "nothing to do".
IDLE_EVENTS = ["SQL*Net message from client", "rdbms ipc message", "SQL*Net break/reset to client"]
IDLE_PATTERN = "%idle wait"
SHORT_WAIT_EVENTS = ["SQL*Net message to client", "SQL*Net more data from client"]
# End of fixed values.


def between_time(df: DataFrame, start, end, c: str = "sample_time") -> DataFrame:
    """Inclusive on both ends."""
    return df.where(F.col(c).between(ts(start), ts(end)))


def last(df: DataFrame, as_of, span: str | dt.timedelta, c: str = "sample_time") -> DataFrame:
    """Rows of the trailing window; span is a timedelta or interval text such as '15 minutes'."""
    if isinstance(span, dt.timedelta):
        step = F.lit(span)
    else:
        step = F.expr(f"INTERVAL '{int(span.split()[0])}' {span.split()[1].rstrip('s').upper()}")
    return df.where(F.col(c) > ts(as_of) - step)


def snap_filter(df: DataFrame, ids, instance=None, dbid=None, c: str = "snap_id") -> DataFrame:
    """Snapshot ids as an inclusive (low, high) tuple or a list, with optional instance and database."""
    cond = F.col(c).between(*ids) if isinstance(ids, tuple) else F.col(c).isin(list(ids))
    if instance is not None:
        cond &= F.col("instance_number" if "instance_number" in df.columns else "inst_id") == instance
    if dbid is not None:
        cond &= F.col("dbid") == dbid
    return df.where(cond)


def at_time(df: DataFrame, mask: str, value: str, c: str = "sample_time") -> DataFrame:
    return df.where(matches(c, mask, value))


def at_latest(df: DataFrame, c: str = "sample_time") -> DataFrame:
    return df.where(F.col(c) == df.select(F.max(c)).scalar())


def at_earliest(df: DataFrame, c: str = "sample_time") -> DataFrame:
    return df.where(F.col(c) == df.select(F.min(c)).scalar())


def drop_idle(df: DataFrame, event: str = "event", wait: str = "wait_time_micro", short_us: int = 1000) -> DataFrame:
    """Drop idle events, and network sends shorter than short_us."""
    e = F.col(event)
    return df.where(~e.isin(IDLE_EVENTS) & ~e.like(IDLE_PATTERN) & ~(e.isin(SHORT_WAIT_EVENTS) & (F.col(wait) < short_us)))


def except_value(df: DataFrame, c: str, value) -> DataFrame:
    """Keep NULLs and everything but value."""
    return df.where(ne_or_null(c, value))


def mutual_pair(df: DataFrame, a, b, waiter: str = "session_id", holder: str = "blocking_session") -> DataFrame:
    """Rows in which a waits for b or b waits for a."""
    w, h = F.col(waiter), F.col(holder)
    return df.where(((w == a) & (h == b)) | ((w == b) & (h == a)))


def has_threshold(df: DataFrame) -> DataFrame:
    """Rows whose warning, critical or key value is set (blanks do not count)."""
    is_set = lambda c: null_if_empty(F.trim(F.col(c))).isNotNull()
    return df.where(is_set("warning_threshold") | is_set("critical_threshold") | is_set("key_value"))


def pattern_filter(df: DataFrame, keep: str | None = None, drop: str | None = None, c: str = "line") -> DataFrame:
    """Rows whose text matches keep and does not match drop (regular expressions)."""
    if keep:
        df = df.where(F.col(c).rlike(keep))
    if drop:
        df = df.where(~F.col(c).rlike(drop))
    return df


def only(df: DataFrame, databases: list[str] | None = None, services: list[str] | None = None) -> DataFrame:
    if databases:
        df = df.where(F.col("database").isin(databases))
    if services:
        df = df.where(F.col("service").isin(services))
    return df


def lookup(df: DataFrame, where: Column | str, order: list[Column] | None = None) -> DataFrame:
    """Single-table lookup, ordered when asked."""
    out = df.where(where)
    return out.orderBy(*order) if order else out


def health_class(status, target, started_hours, within_hours: int, expected_offline: Column | None = None,
                 status_first: bool = False) -> Column:
    """ok, recently restarted, status issue, or offline as expected.

    A recent restart outranks a status issue, except with status_first (services).
    """
    recent = F.coalesce(col(started_hours) < within_hours, F.lit(False)) & (col(started_hours) != 0)
    issue = ne_or_null(col(status), col(target))
    rules = [(issue, "status issue"), (recent, "recently restarted")]
    if not status_first:
        rules.reverse()
    if expected_offline is not None:
        rules.append((expected_offline, "offline as expected"))
    out = F.when(rules[0][0], rules[0][1])
    for cond, label in rules[1:]:
        out = out.when(cond, label)
    return out.otherwise("ok")


