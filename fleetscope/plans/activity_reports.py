"""Session-activity reports.

A per-sample report needs totals, conditional counts, writer throughput and the top events.
All of them come out of one scan: samples are first reduced to one row per (sample, event)
holding partial sums, then ranked and rolled up to one row per sample.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import labels, numbers, text
from ..functions.nulls import asc, desc, glue, nz
from ..functions.numbers import GIB, MIB, count_if, ratio, scaled
from ..functions.times import MINUTE, SECOND, ts
from ..operators import activity, filters, topn
from ..operators.aggregates import with_total


@dataclass(frozen=True)
class Measure:
    """A value that can be summed (or maximised) in two steps."""

    value: Column
    how: str = "sum"

    def partial(self) -> Column:
        return F.max(self.value) if self.how == "max" else F.sum(self.value)

    def final(self, name: str) -> Column:
        return (F.max(name) if self.how == "max" else F.sum(name)).alias(name)


def when(cond: Column, value: Column | int = 1) -> Measure:
    """Sum of value (default: a count) over rows that meet cond."""
    return Measure(F.when(cond, value if isinstance(value, Column) else F.lit(value).cast("bigint")))


def counted(cond: Column) -> Measure:
    return Measure(F.when(cond, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def per_sample(s: DataFrame, measures: dict[str, Measure], n: int, order: list[Column], key: str = "sample_time",
               ties: str = "row_number", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per sample: rolled-up measures and the n best events, from a single scan."""
    waited = nz("time_waited")
    partial = s.groupBy(key, "event").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg(waited).alias("avg_wait_us"),
        numbers.rounded_avg_nz("time_waited", 1000, 1).alias("avg_wait_ms"),
        *[m.partial().alias(f"_m_{k}") for k, m in measures.items()],
    )
    payload = ["event", "sessions", "avg_wait_ms"]
    return (
        topn.rank_in(partial, [key], order, ties)
        .groupBy(key)
        .agg(
            F.sum("sessions").alias("sessions"),
            *[Measure(F.col(f"_m_{k}"), m.how).final(f"_m_{k}") for k, m in measures.items()],
            *topn.wide_aggregates(n, payload),
            *[v.alias(k) for k, v in (extra or {}).items()],
        )
        .select(key, "sessions", *[F.col(f"_m_{k}").alias(k) for k in measures], *topn.unfold(n, payload),
                *(extra or {}))
    )


def _writer(prefix: str, like: str) -> dict[str, Measure]:
    mine = F.col("program").like(like)
    get = lambda c: when(mine, F.col(c))
    return {
        f"{prefix}_sessions": when(mine),
        f"{prefix}_elapsed": get("delta_time"),
        f"{prefix}_elapsed_n": when(mine & F.col("delta_time").isNotNull()),
        f"{prefix}_waited": when(mine, nz("time_waited")),
        f"{prefix}_waited_n": when(mine & (F.col("time_waited") != 0)),
        f"{prefix}_read": get("delta_read_io_bytes"),
        f"{prefix}_written": get("delta_write_io_bytes"),
        f"{prefix}_writes": get("delta_write_io_requests"),
        f"{prefix}_reads": get("delta_read_io_requests"),
    }


def _centis(prefix: str) -> Column:
    """Mean elapsed time of a writer in hundredths of a second."""
    return ratio(f"{prefix}_elapsed", F.col(f"{prefix}_elapsed_n") * 10000)


def _mb_sec(prefix: str, c: str, scale: int = 0) -> Column:
    """Volume rounded to scale digits of a megabyte, over the rounded mean elapsed seconds."""
    steps = ratio(F.col(f"{prefix}_{c}") * 10**scale, MIB)
    return ratio(steps * 100, _centis(prefix) * 10**scale)


def _req_sec(prefix: str, c: str) -> Column:
    return ratio(F.col(f"{prefix}_{c}") * 100, _centis(prefix))


def _waited_ms(prefix: str) -> Column:
    return ratio(f"{prefix}_waited", F.col(f"{prefix}_waited_n") * 1000, 1)


LOG_WRITER, ANY_LOG_WRITER, DB_WRITER = "%LGWR%", "%LG%", "%DBW%"  # fixed values: program patterns


def top2_with_redo(s: DataFrame) -> DataFrame:
    """Two busiest events per sample with I/O totals and log-writer throughput."""
    lgw = F.col("program").like(LOG_WRITER)
    measures = {
        "read": Measure(F.col("delta_read_io_bytes")),
        "write": Measure(F.col("delta_write_io_bytes")),
        "read_requests": Measure(F.col("delta_read_io_requests")),
        "write_requests": Measure(F.col("delta_write_io_requests")),
        "lgw_event": Measure(F.when(lgw, F.col("event")), "max"),
        **_writer("lgw", LOG_WRITER),
    }
    wide = per_sample(s, measures, 2, activity.event_order())
    return wide.select(
        "sample_time",
        F.date_format("sample_time", SECOND).alias("clock"),
        "sessions",
        scaled("read", MIB).alias("read_mb"),
        scaled("write", MIB).alias("write_mb"),
        "read_requests",
        "write_requests",
        *[e for k in (1, 2) for e in (F.coalesce(f"top{k}_event", F.lit("On CPU")).alias(f"top{k}_event"), F.col(f"top{k}_sessions"), F.col(f"top{k}_avg_wait_ms"))],
        _mb_sec("lgw", "written").alias("lgw_mb_sec"),
        "lgw_event",
        _waited_ms("lgw").alias("lgw_waited_ms"),
    ).orderBy(F.col("sample_time").desc())


def top3_with_writers(s: DataFrame, busy: int = 1500) -> DataFrame:
    """Three busiest events per sample, a warning above busy sessions, and both kinds of writers."""
    measures = {
        "pga": Measure(F.col("pga_allocated")),
        "read": Measure(F.col("delta_read_io_bytes")),
        "write": Measure(F.col("delta_write_io_bytes")),
        "read_requests": Measure(F.col("delta_read_io_requests")),
        "write_requests": Measure(F.col("delta_write_io_requests")),
        **_writer("lgw", ANY_LOG_WRITER),
        **_writer("dbw", DB_WRITER),
    }
    order = [desc("sessions"), asc("event")]
    wide = per_sample(s, measures, 3, order)
    return wide.select(
        "sample_time",
        F.date_format("sample_time", SECOND).alias("clock"),
        "sessions",
        scaled("pga", MIB).alias("pga_mb"),
        scaled("read", MIB).alias("read_mb"),
        scaled("write", MIB).alias("write_mb"),
        "read_requests",
        "write_requests",
        F.when(F.col("sessions") > busy, "!!!!!!!").otherwise(" ").alias("warning"),
        *[e for k in (1, 2, 3) for e in (F.coalesce(f"top{k}_event", F.lit("on CPU")).alias(f"top{k}_event"), F.col(f"top{k}_sessions"), F.col(f"top{k}_avg_wait_ms"))],
        *[e for p in ("lgw", "dbw") for e in (
            (_centis(p) / 100.0).alias(f"{p}_spent_sec"), _req_sec(p, "writes").alias(f"{p}_write_requests_sec"),
            _mb_sec(p, "written").alias(f"{p}_mb_sec"), F.col(f"{p}_sessions"))],
    ).orderBy("sample_time")


# What the wide profile counts.
PROFILE_EVENTS = {
    "latch_free": "latch free",
    "latch_call_allocation": "latch: call allocation",
    "library_cache_mutex_x": "library cache: mutex X",
    "enq_dx_contention": "enq: DX contention",
    "latch_shared_pool": "latch: shared pool",
    "enq_tx_index_contention": "enq: TX - index contention",
    "row_cache_mutex": "row cache mutex",
    "enq_sq_contention": "enq: SQ - contention",
    "log_file_sync": "log file sync",
    "db_file_sequential_read": "db file sequential read",
}
PROFILE_CLASSES = ["Concurrency", "Other", "Configuration", "Network", "Application"]
PROFILE_LATCHES = [467, 616]
PROFILE_WAITS = {
    "db_file_sequential_read": "db file sequential read",
    "log_file_sync": "log file sync",
    "log_file_parallel_write": "log file parallel write",
    "lgwr_wait_for_redo_copy": "LGWR wait for redo copy",
}
PROFILE_DB_WRITER_EVENTS = {
    "db_file_parallel_write": "db file parallel write",
    "db_file_async_io_submit": "db file async I/O submit",
    "latch_redo_writing": "latch: redo writing",
}
STATISTICS_ACTION = "ORA$AT_OS_OPT_SY%"
PROFILE_LOG_WRITER, PROFILE_DB_WRITER = "%(LG%", "%(DBW%"
# End of fixed values.


def profile_measures(signatures: Sequence[str]) -> dict[str, Measure]:
    event, wait_class = F.col("event"), F.col("wait_class")
    stats, dbw = F.col("action").like(STATISTICS_ACTION), F.col("program").like(PROFILE_DB_WRITER)
    out = {"on_cpu": counted(event.isNull())}
    out |= {f"class_{c.lower()}": counted(wait_class == c) for c in PROFILE_CLASSES}
    out |= {"in_hard_parse": counted(F.col("in_hard_parse") == "Y"), "in_parse": counted(F.col("in_parse") == "Y")}
    out |= {f"on_{k}": counted(event == e) for k, e in PROFILE_EVENTS.items()}
    out |= {f"on_latch_free_{p}": counted((event == "latch free") & (F.col("p2") == p)) for p in PROFILE_LATCHES}
    out |= {"statistics_sessions": counted(stats), "statistics_read": when(stats, F.col("delta_read_io_bytes"))}
    out |= {f"signature_{x}": counted(F.col("force_matching_signature") == F.lit(x).cast("decimal(20,0)")) for x in signatures}
    for k, e in PROFILE_WAITS.items():
        out[f"wait_{k}"] = when(event == e, nz("time_waited"))
        out[f"wait_{k}_n"] = when((event == e) & (F.col("time_waited") != 0))
    out |= {
        "read": Measure(F.col("delta_read_io_bytes")),
        "write": Measure(F.col("delta_write_io_bytes")),
        "read_requests": Measure(F.col("delta_read_io_requests")),
        "write_requests": Measure(F.col("delta_write_io_requests")),
        "temp": Measure(F.col("temp_space_allocated")),
        "temp_max": Measure(F.col("temp_space_allocated"), "max"),
        "pga": Measure(F.col("pga_allocated")),
        "pga_max": Measure(F.col("pga_allocated"), "max"),
        "dbw_on_cpu": when(dbw, F.when(event.isNull(), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))),
    }
    out |= {f"dbw_on_{k}": when(dbw, F.when(event == e, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))) for k, e in PROFILE_DB_WRITER_EVENTS.items()}
    return out | _writer("lgw", PROFILE_LOG_WRITER) | _writer("dbw", PROFILE_DB_WRITER)


def wide_profile(s: DataFrame, signatures: Sequence[str] = ()) -> DataFrame:
    """Five busiest events per sample with the full set of conditional columns; signatures: statements to count on their own."""
    measures = profile_measures(signatures)
    # names of the log writers' waits, repeated as often as they occur; at most one entry per event here
    lgw_events = F.array_join(
        F.flatten(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_m_lgw_sessions") > 0, F.struct(F.coalesce("event", F.lit("ON CPU")).alias("e"), F.col("_m_lgw_sessions").alias("n"))))),
            lambda x: F.array_repeat(x["e"], x["n"].cast("int")))), ", ")
    wide = per_sample(s, measures, 5, activity.event_order(), extra={"lgw_events": lgw_events})
    as_is = [k for k, m in measures.items() if k.startswith(("on_", "class_", "in_", "signature_", "dbw_on_"))]
    return wide.select(
        "sample_time",
        F.date_format("sample_time", SECOND).alias("clock"),
        "sessions",
        *as_is,
        "statistics_sessions",
        scaled("statistics_read", MIB).alias("statistics_read_mb"),
        *[ratio(f"wait_{k}", F.col(f"wait_{k}_n") * 1000, 1).alias(f"avg_{k}_ms") for k in PROFILE_WAITS],
        scaled("read", MIB).alias("read_mb"),
        scaled("write", MIB).alias("write_mb"),
        scaled("dbw_written", MIB).alias("dbw_write_mb"),
        "read_requests",
        "write_requests",
        F.col("dbw_writes").alias("dbw_write_requests"),
        scaled("temp", GIB, 1).alias("temp_gb"),
        scaled("temp_max", MIB, 1).alias("temp_max_mb"),
        scaled("pga", GIB, 1).alias("pga_gb"),
        scaled("pga_max", MIB, 1).alias("pga_max_mb"),
        *[e for k in range(1, 6) for e in (F.coalesce(f"top{k}_event", F.lit("On CPU")).alias(f"top{k}_event"), F.col(f"top{k}_sessions"), F.col(f"top{k}_avg_wait_ms"))],
        _mb_sec("lgw", "written", 2).alias("lgw_written_mb_sec"),
        _mb_sec("lgw", "read", 2).alias("lgw_read_mb_sec"),
        F.nullif("lgw_events", F.lit("")).alias("lgw_events"),
        _waited_ms("lgw").alias("lgw_waited_ms"),
        F.col("lgw_writes").alias("lgw_write_requests"),
        _req_sec("lgw", "writes").alias("lgw_write_requests_sec"),
        F.col("lgw_reads").alias("lgw_read_requests"),
        "lgw_sessions",
        (_centis("lgw") / 100.0).alias("lgw_spent_sec"),
        _mb_sec("dbw", "written", 2).alias("dbw_written_mb_sec"),
        _mb_sec("dbw", "read", 2).alias("dbw_read_mb_sec"),
        _waited_ms("dbw").alias("dbw_waited_ms"),
        _req_sec("dbw", "writes").alias("dbw_write_requests_sec"),
        _req_sec("dbw", "reads").alias("dbw_read_requests_sec"),
        "dbw_sessions",
    ).orderBy("sample_time")


def top5_waiting(s: DataFrame, n: int = 5, ties: str = "row_number") -> DataFrame:
    """The n waits with most sessions in each sample."""
    waiting = s.where(F.col("session_state") == "WAITING").groupBy("sample_time", "event").agg(F.count(F.lit(1)).alias("sessions"))
    order = [desc("sessions")] + ([asc("event")] if ties == "row_number" else [])
    wide = topn.top_n_wide(waiting, ["sample_time"], ["event", "sessions"], order, n, ties)
    return wide.withColumn("clock", F.date_format("sample_time", SECOND)).orderBy(F.col("sample_time").desc())


def top2_statement_lines(s: DataFrame) -> DataFrame:
    """Two busiest statement plan lines per sample, with parse and execution states and read rate."""
    line = ["sql_id", "sql_plan_hash_value", "sql_plan_line_id", "sql_plan_operation", "sql_plan_options"]
    read_rate = numbers.ratio(F.sum("delta_read_io_bytes").cast("decimal(38,0)") * F.count("delta_time") * 1000000,
                      F.sum("delta_time").cast("decimal(38,0)") * MIB, 2)
    per_line = s.groupBy("sample_time", *line).agg(
        F.count(F.lit(1)).alias("sessions"),
        count_if(F.col("in_sql_execution") == "Y").alias("executing"),
        count_if(F.col("in_hard_parse") == "Y").alias("hard_parsing"),
        F.date_format(F.min("sql_exec_start"), SECOND).alias("earliest_start"),
        read_rate.alias("read_mb_sec"),
    ).withColumn("line", glue(F.col("sql_id"), " - ", F.col("sql_plan_hash_value"), ", plan line - ", F.col("sql_plan_line_id"),
                              ", plan operation - ", F.col("sql_plan_operation"), " ", F.col("sql_plan_options")))
    payload = ["line", "sessions", "executing", "hard_parsing", "earliest_start", "read_mb_sec"]
    # rank over all lines, then roll up: the per-sample total needs every line
    ranked = topn.rank_in(per_line, ["sample_time"], [desc("sessions"), *[asc(c) for c in line]])
    wide = ranked.groupBy("sample_time").agg(F.sum("sessions").alias("sessions"), *topn.wide_aggregates(2, payload))
    drop = ["top2_earliest_start", "top2_read_mb_sec"]
    return wide.select("sample_time", F.date_format("sample_time", SECOND).alias("clock"), "sessions", *topn.unfold(2, payload)).drop(*drop).orderBy(F.col("sample_time").desc())


def wait_history_top3(h: DataFrame) -> DataFrame:
    """Three most frequent recent waits by position in the history, idle waits excluded."""
    per_event = filters.drop_idle(h).groupBy("seq_no", "event").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("wait_time_micro").alias("waited"),
        numbers.rounded_avg("wait_time_micro", 1000, 1).alias("avg_wait_ms"),
        numbers.rounded_avg("time_since_last_wait_micro", 1000, 1).alias("avg_since_last_ms"),
    )
    payload = ["event", "sessions", "avg_wait_ms", "avg_since_last_ms"]
    return topn.top_n_wide(per_event, ["seq_no"], payload, [desc("sessions"), desc("waited"), asc("event")], 3).orderBy("seq_no")


def wait_class_day_compare(s: DataFrame, day1: tuple[str, str], day2: tuple[str, str]) -> DataFrame:
    """Average active sessions per wait class and minute, two days side by side, from one scan."""
    first, second = (F.col("sample_time").between(ts(a), ts(b)) for a, b in (day1, day2))
    tagged = s.where(first | second).withColumn("side", F.when(first, 1).otherwise(2))  # plain ranges reach the scan
    per_minute = activity.by_wait_class(tagged, MINUTE, average=True, keep=("side",))
    values = ["snapshots"] + [activity.class_column(c) for c in labels.WAIT_CLASSES]
    return per_minute.groupBy("sample_clock").agg(
        *[F.max(F.when(F.col("side") == d, F.col(v))).alias(f"day{d}_{v}") for v in values for d in (1, 2)]
    ).orderBy("sample_clock")


def ash_dimensions(s: DataFrame, classes: list[str]) -> DataFrame:
    """Computed dimensions: event with buffer class, normalised program, hexadecimal parameters, plan operation."""
    hexed = lambda c: numbers.hex16(F.when(F.col("session_state") == "WAITING", F.col(c)))
    return s.withColumns({
        "event_text": labels.event_label("event", "session_state", "p3", classes),
        "program_role": text.program_label("program", "session_type"),
        "p1hex": hexed("p1"), "p2hex": hexed("p2"), "p3hex": hexed("p3"),
    })


#: Columns of the activity report that users and objects add.
USER_COLUMNS, OBJECT_COLUMNS = ("username",), ("owner", "object_name", "obj", "objt")


def named_columns(condition: str) -> set[str]:
    """Lower-case words of a SQL condition outside its string literals; its columns are among them."""
    return set(re.findall(r"\w+", re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", " ", condition).lower()))


def activity_report(s: DataFrame, dims: list[str], where: str | Sequence[str] | None, start: str, end: str, weight: int = 1, k: int = 15,
                    users: DataFrame | None = None, objects: DataFrame | None = None, classes: list[str] = ()) -> DataFrame:
    """Seconds, average active sessions and share by any dimensions over a time range.

    where is one SQL condition or several that all must hold. Conditions on samples alone go below the aggregation; one
    that names a column of users or objects goes behind their joins, and the sample columns it names stay as keys until then.
    """
    from ..operators.joins import enrich

    rows = ash_dimensions(filters.between_time(s, start, end), list(classes))
    added = {*(USER_COLUMNS if users is not None else ()), *(OBJECT_COLUMNS if objects is not None else ())} - set(s.columns)
    late: list[str] = []
    for condition in [where] if isinstance(where, str) else where or []:
        if named_columns(condition) & added:
            late.append(condition)
        elif condition:
            rows = rows.where(condition)
    asked = set().union(*map(named_columns, late))
    # samples shrink to one row per raw key and execution before the joins, so a frequent object or user is one key of many equal rows no more
    joined = [c for c, d in (("user_id", users), ("current_obj", objects)) if d is not None]
    keys = dict.fromkeys([*[c for c in rows.columns if c in dims or c.lower() in asked], *joined])
    rows = rows.groupBy(*keys, activity.execution().alias("_exec")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("sample_time").alias("_first"), F.max("sample_time").alias("_last"))
    if users is not None:
        rows = enrich(rows, users.select("user_id", "username"), "user_id")
    if objects is not None:
        rows = enrich(rows, objects.withColumn("obj", F.concat_ws(".", "owner", "object_name"))
                      .select(F.col("object_id").alias("current_obj"), "owner", "object_name", "obj",
                              F.concat(F.col("obj"), F.lit(" ["), F.col("object_type"), F.lit("]")).alias("objt")), "current_obj")
    for condition in late:
        rows = rows.where(condition)
    seconds = F.timestamp_diff("SECOND", ts(start), ts(end))
    grouped = rows.groupBy(*dims).agg(
        F.sum("_n").alias("total_seconds"),
        F.date_format(F.min("_first"), "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.date_format(F.max("_last"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
        F.count_distinct("_exec").alias("executions"),
    )
    return topn.top_k(
        with_total(grouped, "total_seconds", "_total").select(
            (F.col("total_seconds") * weight).alias("total_seconds"),
            ratio(F.col("total_seconds") * weight, seconds, 1).alias("aas"),
            numbers.share("total_seconds", "_total").alias("share"),
            *dims, "first_seen", "last_seen", "executions",
        ),
        [F.col("total_seconds").desc(), *[asc(d) for d in dims]], k)


def top_sessions(s: DataFrame, users: DataFrame, sessions: DataFrame, k: int = 9) -> DataFrame:
    """The k busiest sessions with user names and whether they are still connected."""
    keys = ["session_id", "session_serial", "user_id", "program"]
    busiest = topn.top_k(activity.top_activity(s, keys), [F.col("total").desc(), *[asc(c) for c in keys]], k)
    live = sessions.select(F.col("sid").alias("session_id"), F.col("serial").alias("session_serial"), F.lit("CONNECTED").alias("status"))
    return (
        busiest.join(users.select("user_id", "username"), "user_id")
        .join(live, ["session_id", "session_serial"], "left")
        .select(F.coalesce("status", F.lit("DISCONNECTED")).alias("status"), "session_id", "username", "program", "on_cpu", "in_wait", "on_io", "total")
        .orderBy(F.col("total").desc(), "session_id")
    )
