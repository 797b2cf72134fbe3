"""Statement and metric history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.nulls import asc
from ..functions.numbers import GIB, ratio
from ..functions.times import trunc
from .joins import with_snapshot

def _joined(stat: DataFrame, snap: DataFrame, on: tuple[str, ...]) -> DataFrame:
    if len(on) == 2:  # the full key of snapshots
        return with_snapshot(stat, snap.select(*on, "end_interval_time"), on)
    # one time per id, so that matching by the snapshot id alone does not multiply the facts
    return with_snapshot(stat, snap.groupBy(*on).agg(F.min("end_interval_time").alias("end_interval_time")), on)


def _per_exec(unit: int = 1, scale: int = 0, c: str = "elapsed_time_delta"):
    return ratio(F.sum(c), F.sum("executions_delta") * unit, scale)


def stmt_history(stat: DataFrame, snap: DataFrame, grain: str = "minute", keys: tuple[str, ...] = ("sql_id", "plan_hash_value", "instance_number")) -> DataFrame:
    """Executions, time, reads and rows per statement plan, node and snapshot interval; no executions give NULL ratios."""
    return (
        _joined(stat, snap, ("snap_id", "instance_number"))
        .groupBy(*keys, trunc(grain, "end_interval_time").alias("interval_time"))
        .agg(
            F.sum("executions_delta").alias("execs"),
            _per_exec(1000000, 8).alias("sec_per_exec"),
            _per_exec(c="buffer_gets_delta").alias("gets_per_exec"),
            F.sum("rows_processed_delta").alias("rows_processed"),
        )
    )


def stmt_plans(stat: DataFrame, snap: DataFrame) -> DataFrame:
    """Cost of every plan of a statement per node."""
    return (
        _joined(stat, snap, ("snap_id", "instance_number"))
        .groupBy("sql_id", "plan_hash_value", "instance_number")
        .agg(
            F.sum("executions_delta").alias("execs"),
            _per_exec(1000, 2).alias("ms_per_exec"),
            _per_exec(c="buffer_gets_delta").alias("gets_per_exec"),
            F.sum("rows_processed_delta").alias("rows_processed"),
        )
    )


def stmt_daily(stat: DataFrame, snap: DataFrame) -> DataFrame:
    """All plans of a statement together, per node and day."""
    return (
        _joined(stat, snap, ("snap_id", "instance_number"))
        .groupBy("sql_id", "instance_number", trunc("day", "end_interval_time").alias("day"))
        .agg(
            F.sum("executions_delta").alias("execs"),
            _per_exec(1000000, 2).alias("sec_per_exec"),
            _per_exec(c="buffer_gets_delta").alias("gets_per_exec"),
            _per_exec(1, 1, "rows_processed_delta").alias("rows_per_exec"),
        )
    )


def plan_daily(stat: DataFrame, snap: DataFrame) -> DataFrame:
    """Daily profile of every statement and plan over all nodes; the snapshot is matched by its id alone."""
    return (
        _joined(stat, snap, ("snap_id",))
        .groupBy(trunc("day", "end_interval_time").alias("day"), "sql_id", "plan_hash_value")
        .agg(
            F.avg("optimizer_cost").alias("optimizer_cost"),
            F.max("loaded_versions").alias("loaded_versions"),
            ratio(F.sum("executions_delta"), 1000).alias("execs_thousands"),
            _per_exec(1000000, 4).alias("elapsed_sec_per_exec"),
            _per_exec(1000000, 4, "cpu_time_delta").alias("cpu_sec_per_exec"),
            F.sum("invalidations_delta").cast("bigint").alias("invalidations"),
            F.sum("parse_calls_delta").cast("bigint").alias("parse_calls"),
            ratio(F.sum("disk_reads_delta"), 1000000).alias("disk_reads_mln"),
            _per_exec(c="buffer_gets_delta").alias("gets_per_exec"),
            ratio(F.sum("rows_processed_delta"), 1000000).alias("rows_mln"),
            ratio(F.sum("physical_read_bytes_delta"), GIB).alias("read_gb"),
            ratio(F.sum("physical_read_requests_delta"), 1000000).alias("read_requests_mln"),
        )
    )


def node_compare(stat: DataFrame, snap: DataFrame, nodes: tuple[int, int] = (1, 2)) -> DataFrame:
    """A statement's cost on two nodes side by side, per plan and interval: one scan and one pivot, no self join."""
    per_node = stmt_history(stat.where(F.col("instance_number").isin(*nodes)), snap)
    values = ["execs", "sec_per_exec", "rows_processed", "gets_per_exec"]
    return per_node.groupBy("sql_id", "plan_hash_value", "interval_time").agg(
        *[F.max(F.when(F.col("instance_number") == n, F.col(v))).alias(f"{v}_{i}") for v in values for i, n in enumerate(nodes, 1)])


def stmt_totals(area: DataFrame) -> DataFrame:
    """Executions, elapsed and I/O minutes per statement."""
    return area.groupBy("sql_id").agg(
        F.sum("executions").alias("executions"),
        ratio(F.sum("elapsed_time"), 60000000).alias("elapsed_min"),
        ratio(F.sum("user_io_wait_time"), 60000000).alias("io_wait_min"),
    )


def snap_bounds(snap: DataFrame) -> DataFrame:
    return snap.groupBy("instance_number").agg(F.min("snap_id").alias("first_snap"), F.max("snap_id").alias("last_snap"))


def metric_pivot(m: DataFrame, names: dict[str, int], group_id: int | None = None) -> DataFrame:
    """Metrics as columns per minute, each value rounded to its own number of digits before summing."""
    rows = m.where(F.col("metric_name").isin(list(names)))
    if group_id is not None:
        rows = rows.where(F.col("group_id") == group_id)
    return rows.groupBy("begin_time").agg(
        *[F.sum(F.when(F.col("metric_name") == n, F.round("value", d))).alias(n) for n, d in names.items()])


def newest_first(df: DataFrame, c: str, *more: str) -> DataFrame:
    return df.orderBy(F.col(c).desc_nulls_last(), *[asc(x) for x in more])
