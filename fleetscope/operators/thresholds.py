"""Alert thresholds: resolution, expected settings, defaults and exceptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import labels
from ..functions.nulls import asc, null_if_empty
from ..functions.text import schedule
from ..session import checkpoint
from .aggregates import agg_list
from .filters import has_threshold
from .joins import not_in
from .snapshots import latest_snapshot
from .topn import rank_in

NOT_SPECIFIED = "(not specified)"  # fixed value
SETTING = ["comparison_operator", "warning_threshold", "critical_threshold", "collection_frequency"]
GROUP = ["target_type", "metric", "key_value"]


def threshold_snapshot(targets: DataFrame, settings: DataFrame, collections: DataFrame, titles: DataFrame, groups: DataFrame, date) -> DataFrame:
    """Current thresholds of all targets with readable metric, key, operator and schedule."""
    from ..functions.times import ts

    blank = lambda c: null_if_empty(F.trim(c))
    named = groups.where(F.col("group_type") == "composite").groupBy(F.col("member_guid").alias("target_guid")).agg(agg_list("group_name").alias("groups_grid"))
    label = titles.groupBy("metric_guid").agg(F.min(F.trim("metric_label")).alias("metric_title"))
    # schedules repeat a lot: parse every text once
    plans = collections.select("schedule_xml").distinct().withColumn("collection_frequency", schedule("schedule_xml"))
    collections = collections.join(plans, "schedule_xml", "left").drop("schedule_xml")
    key = F.when(F.col("column_label").isin(labels.USER_METRIC_LABELS), F.col("key_value2")).otherwise(F.col("key_value"))
    # what a row needs is settled before it moves; a target without settings has no threshold
    shown = has_threshold(settings.join(label, "metric_guid", "left").select(
        "target_guid", "metric_guid", "collection_name",
        labels.metric_label("column_label", "metric_name", "collection_name", "metric_title").alias("metric"),
        blank(key).alias("key_value"), labels.comparison_label("critical_operator", "warning_operator").alias("comparison_operator"),
        blank("warning_threshold").alias("warning_threshold"), blank("critical_threshold").alias("critical_threshold"),
        "occurrence_count", *[c for c in ("line_id",) if c in settings.columns]))
    full = (
        shown.join(collections, ["target_guid", "metric_guid", "collection_name"], "left")
        .join(targets.join(named, "target_guid", "left"), "target_guid")
    )
    return full.select(
        ts(date).alias("date_collected"), "target_type", "target_name", "groups_grid", "host_name", "metric", "key_value", "comparison_operator",
        "warning_threshold", "critical_threshold", "occurrence_count", "collection_frequency", "is_enabled",
        *[c for c in ("line_id",) if c in settings.columns])


def user_metrics(current: DataFrame, thresholds: DataFrame, on: list[str], label: str, key: str) -> DataFrame:
    """Labels and keys of user-defined metrics that have a threshold; duplicates go before the join."""
    mine = current.where(F.col(label).like("User%Defined%")).select(*on, label, key).distinct()
    return mine.join(thresholds.select(*on), on, "left_semi").select(label, key).distinct()


def current_settings(hist: DataFrame, ignore_metrics: tuple[str, ...] = (), ignore_hosts: tuple[str, ...] = (), ignore_group: str | None = None) -> DataFrame:
    """Latest thresholds, one row per target, metric and key, with disabled collections marked."""
    rows = latest_snapshot(hist)
    if ignore_group is not None:
        rows = rows.where(~F.col("groups_grid").eqNullSafe(ignore_group))
    if ignore_hosts:
        rows = rows.where(~F.col("host_name").isin(list(ignore_hosts)))
    if ignore_metrics:
        rows = rows.where(~F.col("metric").isin(list(ignore_metrics)))
    return rows.select(
        "target_type", "target_name", "host_name", "metric", F.coalesce("key_value", F.lit(NOT_SPECIFIED)).alias("key_value"),
        "comparison_operator", "warning_threshold", "critical_threshold",
        F.when(F.col("is_enabled") == 0, "Disabled").otherwise(F.col("collection_frequency")).alias("collection_frequency"))


def _targets(cur: DataFrame) -> DataFrame:
    return cur.select("target_type", "target_name", "host_name").distinct()


def missing_settings(cur: DataFrame) -> DataFrame:
    """Per metric and key of a target type: targets expected to have it, having it, and lacking it.

    The grid of all targets and metrics is only counted, never built.
    """
    expected = _targets(cur).groupBy("target_type").agg(F.count(F.lit(1)).alias("expected"))
    present = cur.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("present"))
    return present.join(expected, "target_type").withColumn("missing", F.col("expected") - F.col("present"))


def setting_groups(cur: DataFrame) -> DataFrame:
    """How many targets share each setting of a metric and key, most frequent first; lacking one is a setting too."""
    shared = cur.groupBy(*GROUP, *SETTING).agg(F.count(F.lit(1)).alias("cnt"))
    lacking = missing_settings(cur).where("missing > 0").select(
        *GROUP, *[F.lit(None).cast("string").alias(c) for c in SETTING], F.col("missing").alias("cnt"))
    both = shared.unionByName(lacking).groupBy(*GROUP, *SETTING).agg(F.sum("cnt").alias("cnt"))
    return rank_in(both, GROUP, [F.col("cnt").desc(), *[asc(c) for c in SETTING]])


SALTS = 32


def _lacking_rows(cur: DataFrame, groups: DataFrame) -> DataFrame:
    """Targets without a setting, only where lacking it is not the default.

    There lacking targets are no more than those sharing the default, so the rows compared stay
    below three times the input; salting spreads the targets of a large type.
    """
    unset = reduce(lambda a, b: a & b, [F.isnull(c) for c in SETTING])
    due = groups.where((F.col("rnk") > 1) & unset).select(*GROUP, "cnt").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = _targets(cur).withColumn("_salt", F.pmod(F.xxhash64("target_name", "host_name"), F.lit(SALTS)).cast("int"))
    pairs = salted.join(due, ["target_type", "_salt"]).drop("_salt")
    have = cur.select(*GROUP, "target_name").distinct()
    return pairs.join(have, [*GROUP, "target_name"], "left_anti").select("*", *[F.lit(None).cast("string").alias(c) for c in SETTING])


def default_and_exceptions(cur: DataFrame) -> DataFrame:
    """For every metric and key the setting most targets share, and each target that deviates, with counts."""
    cur = checkpoint(cur)  # one day of settings, read several times below
    groups = setting_groups(cur)
    default = groups.where((F.col("rnk") == 1) & F.col("comparison_operator").isNotNull()).select(
        *GROUP, F.lit(1).alias("is_default"), F.lit("Default value").alias("target_name"), F.lit(None).cast("string").alias("host_name"), *SETTING, "cnt")
    rare = groups.where("rnk > 1").select(*GROUP, *SETTING, "cnt").alias("g")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in (*GROUP, *SETTING)])
    deviating = cur.alias("r").join(rare, same).select(*[F.col(f"r.{c}") for c in (*GROUP, "target_name", "host_name", *SETTING)], "g.cnt")
    other = deviating.unionByName(_lacking_rows(cur, groups)).withColumn("is_default", F.lit(None).cast("int"))
    return default.unionByName(other)


def history_not_latest(hist: DataFrame, cols: list[str], null_safe: bool = True) -> DataFrame:
    """Rows of the history whose values are not among the latest ones."""
    return not_in(hist, latest_snapshot(hist).select(*cols), cols, null_safe)
