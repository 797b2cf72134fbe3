"""Windowed alert metrics.

All use append output: a window is emitted once, when the watermark has passed its end. Rows later
than the watermark are dropped, so state stays bounded by window length, delay and key count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import labels
from ..functions.nulls import nz
from ..functions.numbers import count_if, ratio
from ..operators.activity import class_column
from ..operators.blocking import ALERT_SESSIONS, LONG_WAIT_FACTOR, LONG_WAIT_US


def _bounds(window: str = "w"):
    return F.col(f"{window}.start").alias("window_start"), F.col(f"{window}.end").alias("window_end")


def contention_windows(waits: DataFrame, window: str = "5 minutes", slide: str | None = None, sample: str = "1 second", delay: str = "1 minute",
                       time: str = "sample_time", obj: str = "current_obj", alert_above: int | None = ALERT_SESSIONS) -> DataFrame:
    """Contention per object and trailing window: mean sessions per sample, ten times that after a long wait.

    Sessions are first counted per sample, then samples are combined per window (two chained
    aggregations), so the second one sees one row per sample and object. alert_above=None keeps all rows.
    """
    return _contention(waits.withWatermark(time, delay), window, slide, sample, time, obj, alert_above)


def _contention(timed: DataFrame, window: str, slide: str | None, sample: str, time: str, obj: str, alert_above: int | None) -> DataFrame:
    per_sample = timed.groupBy(F.window(time, sample).alias("s"), obj).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(nz("time_waited")).alias("waited"), F.count(nz("time_waited")).alias("waits"))
    mean = F.try_divide(F.col("waited"), F.col("waits"))
    per_window = per_sample.groupBy(F.window(F.window_time("s"), window, slide).alias("w"), obj).agg(
        F.sum("cnt").alias("sessions_sum"), F.count(F.lit(1)).alias("sample_times"), F.max(mean).alias("max_us"))
    factor = F.when(F.col("max_us") > LONG_WAIT_US, LONG_WAIT_FACTOR).otherwise(1)
    out = per_window.select(*_bounds(), obj, ratio(F.col("sessions_sum") * factor, "sample_times").alias("samples"),
                            ratio("sessions_sum", "sample_times").alias("avg_sessions"), "max_us")
    return out if alert_above is None else out.where(F.col("samples") > alert_above)


def waits_with_holder(waits: DataFrame, samples: DataFrame, event: str, delay: str = "1 minute", reach: str = "10 seconds", time: str = "sample_time") -> DataFrame:
    """The stream of waits on event with contended_obj, the object of the session that is waited for.

    A stream-stream join on the holder and its sample: the wait's own, or the one before for an open wait. Both sides have
    watermarks and the holder's sample lies at most reach before the wait, so state is kept for delay and reach only. A
    wait whose holder was not sampled is given out with its own object once the watermark has passed it. On batch frames
    this gives the rows of operators.blocking.blocker_object. waits and samples are two readers of the same source.
    """
    who = ["blocking_inst_id", "blocking_session", "blocking_session_serial"]
    at = F.when(F.col("time_waited") == 0, F.col("sample_id") - 1).otherwise(F.col("sample_id"))
    w = waits.where(F.col("event") == event).withColumn("_at", at).withWatermark(time, delay)
    h = samples.select(*[F.col(c).alias(f"_{b}") for c, b in zip(("inst_id", "session_id", "session_serial"), who)], F.col("sample_id").alias("_held"),
                       F.col("current_obj").alias("_obj"), F.col(time).alias("_held_time")).withWatermark("_held_time", delay)
    cond = (F.col("_at") == F.col("_held")) & (F.col("_held_time") <= F.col(time)) & (F.col("_held_time") >= F.col(time) - F.expr(f"INTERVAL {reach}"))
    for b in who:
        cond &= F.col(b) == F.col(f"_{b}")
    obj = F.when(F.col("_obj").isNull() | (F.col("_obj") == -1), F.col("current_obj")).otherwise(F.col("_obj"))
    return w.join(h, cond, "left").select(*waits.columns, obj.alias("contended_obj"))


def held_contention_windows(waits: DataFrame, samples: DataFrame, event: str, window: str = "5 minutes", slide: str | None = None, sample: str = "1 second",
                            delay: str = "1 minute", reach: str = "10 seconds", time: str = "sample_time", alert_above: int | None = ALERT_SESSIONS) -> DataFrame:
    """contention_windows by the holder's object."""
    held = waits_with_holder(waits, samples, event, delay, reach, time)
    return _contention(held, window, slide, sample, time, "contended_obj", alert_above)


def failed_login_windows(audit: DataFrame, window: str = "1 hour", more_than: int = 10, delay: str = "10 minutes", time: str = "event_time") -> DataFrame:
    """Users with more than more_than failed logins in a window."""
    failed = audit.where("returncode <> 0").withWatermark(time, delay)
    counted = failed.groupBy(F.window(time, window).alias("w"), "username").agg(F.count(F.lit(1)).alias("attempts"))
    return counted.where(F.col("attempts") > more_than).select(*_bounds(), "username", "attempts")


def wait_class_windows(s: DataFrame, sample: str = "1 second", delay: str = "1 minute", time: str = "sample_time") -> DataFrame:
    """Sessions per wait class and sample."""
    grouped = s.withWatermark(time, delay).groupBy(F.window(time, sample).alias("w")).agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("session_state") == "ON CPU").alias("on_cpu"),
        *[count_if(F.col("wait_class") == c).alias(class_column(c)) for c in labels.WAIT_CLASSES])
    return grouped.select(*_bounds(), *[c for c in grouped.columns if c != "w"])


def event_windows(s: DataFrame, sample: str = "1 second", delay: str = "1 minute", time: str = "sample_time") -> DataFrame:
    """Sessions per event and sample."""
    grouped = s.withWatermark(time, delay).groupBy(F.window(time, sample).alias("w"), "event").agg(F.count(F.lit(1)).alias("sessions"))
    return grouped.select(F.col("w.start").alias("sample_time"), "event", "sessions")
