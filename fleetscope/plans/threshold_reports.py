"""Threshold and group-membership reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.nulls import differs, glue
from ..functions.text import arrow_change
from ..functions.times import DATE_DOTTED
from ..operators import snapshots as N, thresholds as T
from ..session import checkpoint


def _monitored(hist: DataFrame, group: str | None) -> DataFrame:
    return hist if group is None else hist.where(~F.col("groups_grid").eqNullSafe(group))


def _shown(enabled: str, frequency: str):
    return F.when(F.col(enabled) == 0, "Disabled").otherwise(F.col(frequency))


def threshold_changes(hist: DataFrame, ignore_group: str | None = None) -> DataFrame:
    """Thresholds and schedules that changed since the previous collection, for targets present in both."""
    cur, prev = (_monitored(d, ignore_group) for d in N.last_two_snapshots(hist))
    cur = cur.join(N.added(prev, cur, "target_name"), "target_name", "left_anti")
    prev = prev.join(N.removed(prev, cur, "target_name"), "target_name", "left_anti")
    values = ["comparison_operator", "warning_threshold", "critical_threshold", "collection_frequency", "is_enabled", "date_collected"]
    d = N.diff_snapshots(prev, cur, ["target_name", "metric", "key_value"], values)
    p, c = (lambda v: f"previous_{v}"), (lambda v: f"current_{v}")
    on = lambda side: F.coalesce(F.col(side("is_enabled")), F.lit(1))
    warn = differs(c("warning_threshold"), p("warning_threshold"), "0")
    crit = differs(c("critical_threshold"), p("critical_threshold"), "0")
    freq = differs(c("collection_frequency"), p("collection_frequency"), "0")
    state = on(c) != on(p)
    plan = lambda side: glue(on(side), F.col(side("collection_frequency")))
    change = lambda cond, v: F.when(cond, arrow_change(p(v), c(v))).otherwise(F.col(c(v)))
    return d.where(warn | crit | state | freq).select(
        "target_name", "metric", "key_value", F.coalesce(p("comparison_operator"), c("comparison_operator")).alias("comparison_operator"),
        change(warn, "warning_threshold").alias("warning_change"),
        change(crit, "critical_threshold").alias("critical_change"),
        F.when(plan(c) != plan(p), arrow_change(_shown(p("is_enabled"), p("collection_frequency")), _shown(c("is_enabled"), c("collection_frequency"))))
        .otherwise(F.col(c("collection_frequency"))).alias("schedule_change"),
        F.when(warn & crit, "Warn, Crit").when(warn, "Warning").when(crit, "Critical").alias("what_changed"),
        F.date_format(p("date_collected"), DATE_DOTTED).alias("previous_date"),
    ).orderBy("target_name", "metric", "key_value")


def group_changes(hist: DataFrame, ignore_group: str | None = None, keys: tuple[str, ...] = ("target_name",)) -> DataFrame:
    """Targets added, deleted, or moved to other groups since the previous collection."""
    cols = ["target_type", "target_name", "host_name", "groups_grid"]
    cur, prev = (_monitored(d, ignore_group).select("date_collected", *cols).distinct() for d in N.last_two_snapshots(hist))
    d = N.diff_snapshots(prev, cur, list(keys), [c for c in ("date_collected", *cols) if c not in keys])
    both = lambda c: F.col(c) if c in keys else F.coalesce(f"previous_{c}", f"current_{c}")
    moved = differs("previous_groups_grid", "current_groups_grid", "0")
    return d.where(F.col("change").isin("added", "deleted") | moved).select(
        F.col("previous_date_collected").alias("date_collected"), *[both(c).alias(c) for c in cols if c != "groups_grid"],
        F.col("previous_groups_grid").alias("previous_group"), F.col("current_groups_grid").alias("current_group"),
        F.when(F.col("change") == "added", "Target added").when(F.col("change") == "deleted", "Target deleted")
        .otherwise("Group membership changed").alias("operation")).distinct()


def readable_thresholds(hist: DataFrame, ignore_metrics: tuple[str, ...] = (), ignore_hosts: tuple[str, ...] = ()) -> DataFrame:
    """Default and exception lines with repeated labels blanked."""
    lines = checkpoint(T.default_and_exceptions(T.current_settings(hist, ignore_metrics, ignore_hosts))
                       .withColumn("level", F.coalesce("critical_threshold", "warning_threshold")))
    order = ["level", "host_name", "target_name", "comparison_operator", "warning_threshold", "collection_frequency"]
    out = N.suppress_repeats(lines, ["target_type", "metric", "is_default", "key_value"], order)
    return out.withColumn("shown_operator", F.when(F.col("shown_metric").isNotNull(), F.col("comparison_operator"))).drop("shown_is_default", "level")


def target_history(hist: DataFrame, target: str, null_safe: bool = True) -> DataFrame:
    """Latest thresholds of a target, and all earlier ones that are not among them."""
    cols = ["metric", "key_value", "comparison_operator", "warning_threshold", "critical_threshold"]
    mine = hist.where(F.col("target_name") == target)
    latest = mine.where(F.col("date_collected") == hist.select(F.max("date_collected")).scalar())
    earlier = T.not_in(mine, latest.select(*cols), cols, null_safe)
    shape = lambda df: df.select("date_collected", "target_type", "target_name", "host_name", "metric",
                                 F.coalesce("key_value", F.lit(T.NOT_SPECIFIED)).alias("key_value"), *cols[2:])
    return shape(latest).unionByName(shape(earlier)).orderBy(F.col("date_collected").desc(), "metric", "key_value")


def latest_flat(hist: DataFrame, metric: str | None = None, ignore_group: str | None = None) -> DataFrame:
    """Latest thresholds as a flat list, for all metrics or one."""
    rows = _monitored(N.latest_snapshot(hist), ignore_group)
    if metric:
        rows = rows.where(F.col("metric") == metric)
    return rows.where("warning_threshold IS NOT NULL OR critical_threshold IS NOT NULL").select(
        "metric", "target_type", "target_name", "host_name", "key_value", "warning_threshold", "critical_threshold",
        _shown("is_enabled", "collection_frequency").alias("collection_frequency"))
