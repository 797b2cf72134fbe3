"""Statement and metric history queries."""

from pyspark.sql import Window, functions as F

from ..functions.numbers import GIB, ratio
from ..operators import activity as A, filters as P, joins as J, statements as S
from .registry import query, rounded

JOINED = "stmt_stat s JOIN snapshots n ON n.snap_id = s.snap_id AND n.instance_number = s.instance_number"
MINUTE, DAY = "CAST(date_trunc('minute', end_interval_time) AS TIMESTAMP)", "CAST(date_trunc('day', end_interval_time) AS TIMESTAMP)"
EXECS = "CAST(sum(executions_delta) AS BIGINT) AS execs"


def per_exec(c, unit=1, scale=0):
    return rounded(f"sum({c})", f"(sum(executions_delta) * {unit})", scale)


@query("j03_facts_with_snapshot", f"SELECT s.snap_id, s.instance_number, sql_id, end_interval_time FROM {JOINED}")
def _(t):
    return J.with_snapshot(t.stmt_stat, t.snapshots).select("snap_id", "instance_number", "sql_id", "end_interval_time")


HISTORY = f"""SELECT sql_id, plan_hash_value, s.instance_number, {MINUTE} AS interval_time, {EXECS}, {per_exec('elapsed_time_delta', 1000000, 8)} AS sec_per_exec,
  {per_exec('buffer_gets_delta')} AS gets_per_exec, CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed FROM {JOINED} GROUP BY 1, 2, 3, 4"""


@query("a12_statement_history", HISTORY)
def _(t):
    return S.stmt_history(t.stmt_stat, t.snapshots)


@query("a12_statement_plans", f"""SELECT sql_id, plan_hash_value, s.instance_number, {EXECS}, {per_exec('elapsed_time_delta', 1000, 2)} AS ms_per_exec,
  {per_exec('buffer_gets_delta')} AS gets_per_exec, CAST(sum(rows_processed_delta) AS BIGINT) AS rows_processed FROM {JOINED} WHERE sql_id = 'Brand#7' GROUP BY 1, 2, 3""")
def _(t):
    return S.newest_first(S.stmt_plans(t.stmt_stat.where("sql_id = 'Brand#7'"), t.snapshots), "ms_per_exec", "plan_hash_value", "instance_number")


PLAN_DAILY = f"""SELECT {DAY} AS day, sql_id, plan_hash_value, avg(optimizer_cost) AS optimizer_cost, max(loaded_versions) AS loaded_versions,
  {rounded('sum(executions_delta)', '1000')} AS execs_thousands, {per_exec('elapsed_time_delta', 1000000, 4)} AS elapsed_sec_per_exec,
  {per_exec('cpu_time_delta', 1000000, 4)} AS cpu_sec_per_exec, CAST(sum(invalidations_delta) AS BIGINT) AS invalidations, CAST(sum(parse_calls_delta) AS BIGINT) AS parse_calls,
  {rounded('sum(disk_reads_delta)', '1000000')} AS disk_reads_mln, {per_exec('buffer_gets_delta')} AS gets_per_exec, {rounded('sum(rows_processed_delta)', '1000000')} AS rows_mln,
  {rounded('sum(physical_read_bytes_delta)', '1073741824')} AS read_gb, {rounded('sum(physical_read_requests_delta)', '1000000')} AS read_requests_mln
  FROM stmt_stat s JOIN (SELECT DISTINCT snap_id, end_interval_time FROM snapshots) n ON n.snap_id = s.snap_id GROUP BY 1, 2, 3"""


@query("a13_plan_daily", PLAN_DAILY)
def _(t):
    return S.plan_daily(t.stmt_stat, t.snapshots)


STMT_DAILY = f"""SELECT sql_id, s.instance_number, {DAY} AS day, {EXECS}, {per_exec('elapsed_time_delta', 1000000, 2)} AS sec_per_exec,
  {per_exec('buffer_gets_delta')} AS gets_per_exec, {per_exec('rows_processed_delta', 1, 1)} AS rows_per_exec FROM {JOINED} GROUP BY 1, 2, 3"""


@query("r13_statement_trend_by_day", STMT_DAILY)
def _(t):
    return S.newest_first(S.stmt_daily(t.stmt_stat, t.snapshots), "day", "sql_id", "instance_number")


def _side(n):
    return f"(SELECT * FROM history WHERE instance_number = {n})"


NODES = f"""WITH history AS ({HISTORY}) SELECT coalesce(a.sql_id, b.sql_id) AS sql_id, coalesce(a.plan_hash_value, b.plan_hash_value) AS plan_hash_value,
  coalesce(a.interval_time, b.interval_time) AS interval_time, {", ".join(f"{x}.{v} AS {v}_{i}" for v in ("execs", "sec_per_exec", "rows_processed", "gets_per_exec") for i, x in ((1, "a"), (2, "b")))}
  FROM {_side(1)} a FULL JOIN {_side(2)} b ON a.sql_id = b.sql_id AND a.plan_hash_value = b.plan_hash_value AND a.interval_time = b.interval_time"""


@query("r12_two_node_statement_compare", NODES)
def _(t):
    return S.node_compare(t.stmt_stat, t.snapshots)


@query("j04_full_outer_compare", """SELECT coalesce(a.plan_hash_value, b.plan_hash_value) AS plan_hash_value, a.n AS first_n, b.n AS second_n FROM
  (SELECT plan_hash_value, count(*) AS n FROM stmt_stat WHERE instance_number = 1 GROUP BY 1) a FULL JOIN
  (SELECT plan_hash_value, count(*) AS n FROM stmt_stat WHERE instance_number = 2 GROUP BY 1) b ON a.plan_hash_value = b.plan_hash_value""")
def _(t):
    side = lambda node: A.count_by(t.stmt_stat.where(F.col("instance_number") == node), ["plan_hash_value"], "n")
    return J.compare(side(1), side(2), ["plan_hash_value"], ("first", "second"))


@query("a14_statement_totals", f"""SELECT sql_id, CAST(sum(executions) AS BIGINT) AS executions, {rounded('sum(elapsed_time)', '60000000')} AS elapsed_min,
  {rounded('sum(user_io_wait_time)', '60000000')} AS io_wait_min FROM statements GROUP BY sql_id""")
def _(t):
    return S.stmt_totals(t.statements)


@query("a15_reads_by_statement", f"""SELECT r.sql_id, sessions, read_bytes, sql_text, {rounded('read_bytes', '1073741824', 1)} AS read_gb FROM
  (SELECT sql_id, count(DISTINCT session_id) AS sessions, CAST(sum(delta_read_io_bytes) AS BIGINT) AS read_bytes FROM samples WHERE sample_time > TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1) r
  LEFT JOIN statements q ON q.sql_id = r.sql_id""")
def _(t):
    return A.read_by_statement(P.last(t.samples, "2024-01-31 00:00:00", "11 days"), t.statements)


@query("a15_reads_by_statement_and_object", f"""SELECT r.sql_id, r.current_obj, sessions, read_bytes, sql_text, object_name, subobject_name, {rounded('read_bytes', '1073741824', 1)} AS read_gb FROM
  (SELECT sql_id, current_obj, count(DISTINCT session_id) AS sessions, CAST(sum(delta_read_io_bytes) AS BIGINT) AS read_bytes FROM samples GROUP BY 1, 2) r
  LEFT JOIN statements q ON q.sql_id = r.sql_id LEFT JOIN objects o ON o.object_id = r.current_obj""")
def _(t):
    return A.read_by_statement(t.samples, t.statements, t.objects)


@query("a39_snapshot_bounds", """SELECT instance_number, min(snap_id) AS first_snap, max(snap_id) AS last_snap FROM snapshots
  WHERE end_interval_time BETWEEN TIMESTAMP '1996-07-21 12:00:00' AND TIMESTAMP '1996-09-21 15:00:00' GROUP BY 1""")
def _(t):
    return S.snap_bounds(P.between_time(t.snapshots, "1996-07-21 12:00:00", "1996-09-21 15:00:00", "end_interval_time"))


METRICS = {"click": 0, "purchase": 4, "error": 0, "signup": 1}


def _metric_sql(group):
    cols = ", ".join(f"CAST(sum(CASE WHEN metric_name = '{n}' THEN round(value, {d}) END) AS DOUBLE) AS {n}" for n, d in METRICS.items())
    return f"SELECT begin_time, {cols} FROM metrics WHERE metric_name IN ('click', 'purchase', 'error', 'signup') {group} GROUP BY begin_time"


def _metrics(df):
    return df.select("begin_time", *[F.col(n).cast("double").alias(n) for n in METRICS])


@query("a20_metric_pivot", _metric_sql(""))
def _(t):
    return _metrics(S.metric_pivot(t.metrics, METRICS))


@query("r33_metric_history", _metric_sql("AND group_id = 2 AND begin_time > TIMESTAMP '2024-01-20 00:00:00'"))
def _(t):
    recent = P.last(t.metrics, "2024-01-31 00:00:00", "11 days", "begin_time")
    return S.newest_first(_metrics(S.metric_pivot(recent, METRICS, group_id=2)), "begin_time")


@query("j31_statements_with_cursor_area", """SELECT s.inst_id, s.sql_id, s.plan_hash_value, first_load_time, parse_calls, executions FROM statements s
  LEFT JOIN cursor_area c ON c.sql_id = s.sql_id AND c.plan_hash_value = s.plan_hash_value AND c.inst_id = s.inst_id""")
def _(t):
    return J.enrich(t.statements, t.cursor_area, ["sql_id", "plan_hash_value", "inst_id"]) \
        .select("inst_id", "sql_id", "plan_hash_value", "first_load_time", "parse_calls", "executions")


@query("j29_capped_join_count", """SELECT CAST(least(sum(a.n * b.n), 1999999) AS BIGINT) AS cnt FROM (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a
  JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) b USING (l_suppkey)""")
def _(t):
    return J.capped_join_count(t.lineitem.where("l_returnflag = 'R'"), t.lineitem, "l_suppkey", 1999999)


@query("j29_join_count", "SELECT count(*) AS cnt FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey")
def _(t):
    return J.capped_join_count(t.orders, t.orders, "o_custkey", 5_000_000_000 - 1)


@query("t05_numeric_order_of_text", """SELECT inst_id, name, value, date_collected, dense_rank() OVER (PARTITION BY name
  ORDER BY CAST(value AS DECIMAL(38,4)) DESC NULLS LAST) AS place FROM measures""")
def _(t):
    from ..functions.numbers import to_number
    from ..operators.ordered import places
    rows = t.measures.select("inst_id", "name", "value", "date_collected", to_number("value").alias("number"))
    return places(rows, ["name"], "number", descending=True).drop("number")


@query("a42_counts_and_ratios", f"""SELECT tablespace_name, autoextensible, count(*) AS cnt, {rounded('sum(blocks)', '1073741824', 6)} AS blocks_g FROM files GROUP BY 1, 2""")
def _(t):
    return t.files.groupBy("tablespace_name", "autoextensible").agg(F.count(F.lit(1)).alias("cnt"), ratio(F.sum("blocks"), GIB, 6).alias("blocks_g"))
