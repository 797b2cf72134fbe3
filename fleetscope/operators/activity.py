"""Aggregations over session samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import labels
from ..functions.nulls import asc, desc, glue, nz
from ..functions.numbers import GIB, MIB, count_if, ratio, rounded_avg_nz, scaled
from ..functions.times import DATE, SECOND
from . import topn

ON_CPU = "ON CPU"


def class_column(wait_class: str) -> str:
    return wait_class.lower().replace("/", "").replace(" ", "_")


def sample_events(s: DataFrame, by: tuple[str, ...] = ("sample_time",), item: tuple[str, ...] = ("event",)) -> DataFrame:
    """Sessions, mean wait and mean elapsed time per group and item."""
    waited = nz("time_waited")
    return s.groupBy(*by, *item).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg(waited).alias("avg_wait_us"),
        rounded_avg_nz("time_waited", 1000, 1).alias("avg_wait_ms"),
        ratio(F.sum("tm_delta_time"), F.count("tm_delta_time") * 1000000, 2).alias("spent_sec"),
    )


def sample_totals(s: DataFrame, by: tuple[str, ...] = ("sample_time",)) -> DataFrame:
    """Sessions, I/O volume and memory per sample."""
    return s.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"),
        scaled(F.sum("delta_read_io_bytes"), MIB).alias("read_mb"),
        scaled(F.sum("delta_write_io_bytes"), MIB).alias("write_mb"),
        F.sum("delta_read_io_requests").alias("read_requests"),
        F.sum("delta_write_io_requests").alias("write_requests"),
        scaled(F.sum("pga_allocated"), GIB, 3).alias("pga_gb"),
        scaled(F.max("pga_allocated"), MIB, 1).alias("pga_max_mb"),
        scaled(F.sum("temp_space_allocated"), GIB, 3).alias("temp_gb"),
        scaled(F.max("temp_space_allocated"), MIB, 1).alias("temp_max_mb"),
    )


def _class_counts() -> dict[str, Column]:
    return {class_column(c): count_if(F.col("wait_class") == c) for c in labels.WAIT_CLASSES}


def by_wait_class(s: DataFrame, grain: str = SECOND, average: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sessions per wait class and formatted time; average divides by the number of samples."""
    snapshots = F.count_distinct("sample_id")
    counts = _class_counts()
    if average:
        counts = {k: ratio(v, snapshots) for k, v in counts.items()}
    return s.groupBy(
        *keep, F.date_format("sample_time", DATE).alias("sample_date"), F.date_format("sample_time", grain).alias("sample_clock")
    ).agg(
        F.count(F.lit(1)).alias("total"),
        snapshots.alias("snapshots"),
        count_if(F.col("session_state") == "ON CPU").alias("on_cpu"),
        ratio(F.sum("tm_delta_cpu_time"), 1000000, 1).alias("cpu_sec"),
        *[v.alias(k) for k, v in counts.items()],
    )


def conditional_profile(s: DataFrame, specs: dict[str, Column], by: tuple[str, ...] = ("sample_time",)) -> DataFrame:
    """Any set of named (conditional) aggregates in one pass."""
    return s.groupBy(*by).agg(*[v.alias(k) for k, v in specs.items()])


def writer_stats(s: DataFrame, like: str, divisor: str = "avg") -> DataFrame:
    """Throughput of background writers per sample: volume over mean (or summed) elapsed seconds."""
    elapsed = F.sum("delta_time")
    mb = scaled(F.sum("delta_write_io_bytes"), MIB)
    centis = ratio(elapsed, F.count("delta_time") * 10000) if divisor == "avg" else ratio(elapsed, 10000)
    return s.where(F.col("program").like(like)).groupBy("sample_time").agg(
        F.max("event").alias("event"),
        F.count(F.lit(1)).alias("processes"),
        (centis / 100.0).alias("spent_sec"),
        mb.alias("written_mb"),
        F.sum("delta_write_io_requests").alias("write_requests"),
        ratio(mb * 100, centis).alias("written_mb_sec"),
        ratio(F.sum("delta_write_io_requests") * 100, centis).alias("write_requests_sec"),
        rounded_avg_nz("time_waited", 1000, 1).alias("waited_ms"),
    )


def top_activity(s: DataFrame, dims: list[Column | str]) -> DataFrame:
    """Samples on CPU, waiting, on I/O and in total for any dimensions."""
    io = (F.col("session_state") == "WAITING") & F.col("wait_class").eqNullSafe("User I/O")
    waiting = (F.col("session_state") == "WAITING") & ~F.col("wait_class").eqNullSafe("User I/O")
    return s.groupBy(*dims).agg(
        count_if(F.col("session_state") == "ON CPU").alias("on_cpu"),
        count_if(waiting).alias("in_wait"),
        count_if(io).alias("on_io"),
        F.count(F.lit(1)).alias("total"),
    )


def average_active(samples: Column, seconds: int, weight: int = 1) -> Column:
    """Average active sessions over a time range."""
    return ratio(samples * weight, seconds, 1)


def execution() -> Column:
    """Which execution of its statement a sample belongs to; one value for all samples without execution data."""
    stamp = F.date_format("sql_exec_start", "yyyy-MM-dd HH:mm:ss")
    return glue(stamp, F.lit(":"), F.col("sql_exec_id"))


def distinct_executions() -> Column:
    """Executions seen; rows without execution data count as one."""
    return F.count_distinct(execution())


def count_by(df: DataFrame, dims: list[Column | str], name: str = "cnt") -> DataFrame:
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias(name))


def weighted_total(s: DataFrame, dims: list[str]) -> DataFrame:
    """Sample count times the rounded mean wait per group."""
    return (
        s.groupBy(*dims)
        .agg(F.count(F.lit(1)).alias("samples"), ratio(F.sum("time_waited"), F.count("time_waited") * 1000).alias("avg_wait_ms"))
        .withColumn("total_ms", F.col("avg_wait_ms") * F.col("samples"))
    )


def waiters(s: DataFrame, dims: list[str]) -> DataFrame:
    """Waiting sessions per call site, with one of them named."""
    return s.groupBy(*dims).agg(F.max("session_id").alias("one_waiter"), F.count(F.lit(1)).alias("cnt"))


def waits_impact(s: DataFrame, dims: list[str]) -> DataFrame:
    """Sessions affected and total wait per group."""
    return s.groupBy(*dims).agg(
        F.count_distinct("session_id").alias("sessions_affected"), ratio(F.sum("time_waited"), 1000000).alias("waited_sec")
    )


def read_by_statement(s: DataFrame, statements: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """Read volume and sessions per statement (and object); texts join after the aggregation."""
    keys = ["sql_id"] + (["current_obj"] if objects is not None else [])
    out = s.groupBy(*keys).agg(
        F.count_distinct("session_id").alias("sessions"),
        F.sum("delta_read_io_bytes").alias("read_bytes"),
    )
    out = out.join(statements.select("sql_id", "sql_text"), "sql_id", "left")
    if objects is not None:
        names = objects.select(F.col("object_id").alias("current_obj"), "object_name", "subobject_name")
        out = out.join(names, "current_obj", "left")
    return out.withColumn("read_gb", scaled("read_bytes", GIB, 1))


def exec_spans(s: DataFrame) -> DataFrame:
    """First and last sighting of every execution."""
    return s.groupBy("sql_exec_id", "sql_exec_start", "module", "session_id").agg(
        F.min("sample_time").alias("started"),
        F.max("sample_time").alias("ended"),
        F.timestamp_diff("SECOND", F.min("sample_time"), F.max("sample_time")).alias("elapsed_sec"),
    )


def exec_waits(s: DataFrame) -> DataFrame:
    """CPU and waits of every execution."""
    return s.groupBy("sql_exec_start", F.coalesce("event", F.lit(ON_CPU)).alias("wait_event")).agg(
        F.count(F.lit(1)).alias("samples"),
        ratio(F.sum("tm_delta_time"), 1000000).alias("tm_delta_sec"),
        ratio(F.sum("delta_time"), 1000000).alias("delta_sec"),
        F.timestamp_diff("SECOND", F.min("sample_time"), F.max("sample_time")).alias("elapsed_sec"),
    )


PX_FLAG_UNIT = 2097152  # fixed value: the degree starts at this bit of px_flags


def exec_parallel(s: DataFrame) -> DataFrame:
    """Executions with their workers folded into the coordinator, and the degree."""
    return (
        s.groupBy(
            F.coalesce("qc_session_id", "session_id").alias("session_id"), "px_flags", "sql_exec_id", "sql_exec_start",
            F.coalesce("event", F.lit(ON_CPU)).alias("wait_event"),
        )
        .agg(
            F.count(F.lit(1)).alias("samples"),
            ratio(F.sum("tm_delta_cpu_time"), 1000000).alias("cpu_sec"),
            ratio(F.sum("tm_delta_db_time"), 1000000).alias("db_sec"),
            F.timestamp_diff("SECOND", F.min("sample_time"), F.max("sample_time")).alias("elapsed_sec"),
        )
        .withColumn("degree", ratio("px_flags", PX_FLAG_UNIT))
    )


def event_order() -> list[Column]:
    """Most sessions first, then longest mean wait, then event name."""
    return [desc("sessions"), desc("avg_wait_us"), asc("event")]


def top_events(s: DataFrame, n: int, order: list[Column] | None = None, ties: str = "row_number") -> DataFrame:
    """The n busiest events of each sample side by side."""
    per_event = sample_events(s)
    return topn.top_n_wide(per_event, ["sample_time"], ["event", "sessions", "avg_wait_ms"], order or event_order(), n, ties)
