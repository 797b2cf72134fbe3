"""Dates: truncation, differences, formatted matching and duration texts."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, functions as F

from .nulls import col

DATE = "yyyy-MM-dd"
DATE_DOTTED = "dd.MM.yyyy"
MINUTE = "HH:mm"
SECOND = "HH:mm:ss"
STAMP = "yyyy-MM-dd HH:mm:ss"
STAMP_DOTTED = "dd.MM.yyyy HH:mm:ss"
MINUTE_DOTTED = "dd.MM.yyyy HH:mm"

# strptime form and resolution of the masks that contain a full date
_DATED = {
    DATE: ("%Y-%m-%d", dt.timedelta(days=1)),
    DATE_DOTTED: ("%d.%m.%Y", dt.timedelta(days=1)),
    STAMP: ("%Y-%m-%d %H:%M:%S", dt.timedelta(seconds=1)),
    STAMP_DOTTED: ("%d.%m.%Y %H:%M:%S", dt.timedelta(seconds=1)),
    MINUTE_DOTTED: ("%d.%m.%Y %H:%M", dt.timedelta(minutes=1)),
}


def ts(value: str | dt.datetime | Column) -> Column:
    """A timestamp literal without time zone."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def trunc(unit: str, c) -> Column:
    return F.date_trunc(unit, col(c)).cast("timestamp_ntz")


def seconds_between(start, end) -> Column:
    """Whole seconds from start to end."""
    return F.timestamp_diff("SECOND", col(start), col(end))


def matches(c, mask: str, value: str) -> Column:
    """The formatted time equals value; a dated mask becomes a range the scan can prune on."""
    if mask in _DATED:
        form, step = _DATED[mask]
        at = dt.datetime.strptime(value, form)
        return (col(c) >= ts(at)) & (col(c) < ts(at + step))
    return F.date_format(col(c), mask) == F.lit(value)


def interval_minutes(c) -> Column:
    """Whole minutes of a day-time interval."""
    part = lambda unit: F.extract(F.lit(unit), col(c)).cast("bigint")
    return part("DAY") * 24 * 60 + part("HOUR") * 60 + part("MINUTE")


# a month is 31 days and a year 365 days here
_UNIT_HOURS = {"h": 1, "d": 24, "w": 24 * 7, "m": 24 * 31, "y": 24 * 365}


def duration_hours(text: str) -> int:
    """Hours in a duration such as '12', '2d' or '3w'."""
    m = re.fullmatch(r"(\d+)([hdwmy]?)", text.strip())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * _UNIT_HOURS[m[2] or "h"]


def duration_hours_col(c) -> Column:
    units = F.create_map(*[F.lit(x) for kv in {**_UNIT_HOURS, "": 1}.items() for x in kv])
    return F.regexp_extract(col(c), r"^(\d+)", 1).try_cast("bigint") * units[F.regexp_extract(col(c), r"^\d+([hdwmy]?)$", 1)]


NEVER_HOURS = 999999999999  # fixed value: "never restarted"


def hours_since(c, now: str) -> Column:
    """Whole hours from a date text (MM/dd/yyyy HH:mm:ss or epoch seconds) to now; NEVER, 0 and blanks are endless."""
    text, epoch = F.rtrim(col(c)), dt.datetime(1970, 1, 1)
    stamp = F.try_to_timestamp(text, F.lit("MM/dd/yyyy HH:mm:ss")).cast("timestamp_ntz")
    second = F.coalesce(F.nullif(text.try_cast("bigint"), F.lit(0).cast("bigint")), F.timestamp_diff("SECOND", ts(epoch), stamp))
    until = int((dt.datetime.fromisoformat(now) - epoch).total_seconds())
    return F.coalesce(F.call_function("div", F.lit(until).cast("bigint") - second, F.lit(3600).cast("bigint")), F.lit(NEVER_HOURS))


def as_instant(c) -> Column:
    """A zone-free time as the UTC instant with the same digits; watermarks need an instant."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(c)))


def from_instant(c) -> Column:
    """Inverse of as_instant, whatever the session time zone."""
    seconds = (F.unix_micros(col(c)) / F.lit(1000000).cast("decimal(18,0)")).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)
