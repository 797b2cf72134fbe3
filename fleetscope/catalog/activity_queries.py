"""Session-activity queries: filters, aggregations, ranking and the per-sample reports."""

from pyspark.sql import functions as F

from ..functions import labels, numbers, text
from ..functions.nulls import asc, desc
from ..functions.times import MINUTE, MINUTE_DOTTED
from ..operators import activity as A, filters as P, joins as J, topn
from ..operators.aggregates import with_total
from ..plans import activity_reports as R
from .registry import query, rounded

START, END = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
AS_OF = "2024-01-31 00:00:00"
BUFFER_CLASSES = [f"class {i}" for i in range(1, 19)]
CLASSES = [(A.class_column(c), c) for c in labels.WAIT_CLASSES]

# ---- filters -----------------------------------------------------------------------------

@query("p01_between_time", f"""SELECT sample_time, session_id, event FROM samples
  WHERE sample_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'""")
def _(t):
    return P.between_time(t.samples, START, END).select("sample_time", "session_id", "event")


@query("p02_trailing_window", f"SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 36 HOUR")
def _(t):
    return P.last(t.events, AS_OF, "36 hours", "ts").select("event_id", "ts")


@query("p03_snapshot_range", "SELECT snap_id, inst_id, session_id FROM samples WHERE snap_id BETWEEN 740790 AND 740800 AND inst_id = 1")
def _(t):
    return P.snap_filter(t.samples, (740790, 740800), instance=1).select("snap_id", "inst_id", "session_id")


@query("p03_snapshot_list", "SELECT snap_id, inst_id, session_id FROM samples WHERE snap_id IN (740786, 740791)")
def _(t):
    return P.snap_filter(t.samples, [740786, 740791]).select("snap_id", "inst_id", "session_id")


@query("p04_at_clock_time", "SELECT event_id, ts FROM events WHERE strftime(ts, '%H:%M') = '08:54'")
def _(t):
    return P.at_time(t.events, MINUTE, "08:54", "ts").select("event_id", "ts")


@query("p04_at_dated_minute", "SELECT sample_id, session_id FROM samples WHERE strftime(sample_time, '%d.%m.%Y %H:%M') = '09.01.2024 08:00'")
def _(t):
    return P.at_time(t.samples, MINUTE_DOTTED, "09.01.2024 08:00").select("sample_id", "session_id")


@query("p05_drop_idle", """SELECT seq_no, sid, event, wait_time_micro FROM wait_history
  WHERE event NOT IN ('SQL*Net message from client', 'rdbms ipc message', 'SQL*Net break/reset to client') AND event NOT LIKE '%idle wait'
    AND NOT (event IN ('SQL*Net message to client', 'SQL*Net more data from client') AND wait_time_micro < 1000)""")
def _(t):
    return P.drop_idle(t.wait_history).select("seq_no", "sid", "event", "wait_time_micro")


@query("p06_not_equal_or_null", "SELECT session_id, sample_id, event FROM samples WHERE event IS DISTINCT FROM 'log file sync'")
def _(t):
    return P.except_value(t.samples, "event", "log file sync").select("session_id", "sample_id", "event")


@query("p07_at_latest_sample", "SELECT sample_id, session_id FROM samples WHERE sample_time = (SELECT max(sample_time) FROM samples)")
def _(t):
    return P.at_latest(t.samples).select("sample_id", "session_id")


@query("p07_at_earliest_sample", "SELECT sample_id, session_id FROM samples WHERE sample_time = (SELECT min(sample_time) FROM samples)")
def _(t):
    return P.at_earliest(t.samples).select("sample_id", "session_id")


@query("p08_free_dimensions", "SELECT program, sql_id, count(*) AS cnt FROM samples WHERE session_state = 'WAITING' AND time_waited > 5000000 GROUP BY program, sql_id")
def _(t):
    return A.count_by(t.samples.where("session_state = 'WAITING' AND time_waited > 5000000"), ["program", "sql_id"])


@query("p09_mutual_pair", "SELECT sample_id, session_id, blocking_session FROM samples WHERE (session_id = 14 AND blocking_session = 15) OR (session_id = 15 AND blocking_session = 14)")
def _(t):
    return P.mutual_pair(t.samples, 14, 15).select("sample_id", "session_id", "blocking_session")


@query("p10_code_labels", """SELECT returncode, CASE returncode WHEN 28000 THEN 'Account is locked' WHEN 28001 THEN 'Password is expired'
    WHEN 1017 THEN 'Invalid username or password' WHEN 1045 THEN 'User lacks CREATE SESSION privilege' END AS message, count(*) AS cnt
  FROM audit GROUP BY 1, 2""")
def _(t):
    return A.count_by(t.audit, ["returncode", labels.return_code_label("returncode").alias("message")])


@query("p13_distinct", "SELECT DISTINCT event, wait_class FROM samples")
def _(t):
    return t.samples.select("event", "wait_class").distinct()


@query("s01_weighted_samples", "SELECT sample_id, session_id, 10 AS weight FROM samples")
def _(t):
    from ..sources.samples import weighted
    return weighted(t.samples, 10).select("sample_id", "session_id", "weight")


@query("s14_lookup_newest_first", "SELECT sample_time, session_id, event FROM samples WHERE sql_id = 'q3' AND program LIKE '%LGWR%'")
def _(t):
    return P.lookup(t.samples, (F.col("sql_id") == "q3") & F.col("program").like("%LGWR%"), [F.col("sample_time").desc(), F.col("session_id")]) \
        .select("sample_time", "session_id", "event")

# ---- aggregations ------------------------------------------------------------------------

@query("a01_sample_events", f"""SELECT sample_time, event, count(*) AS sessions, avg(nullif(time_waited, 0)) AS avg_wait_us,
    {rounded('sum(nullif(time_waited, 0))', '(count(nullif(time_waited, 0)) * 1000)', 1)} AS avg_wait_ms,
    {rounded('sum(tm_delta_time)', '(count(tm_delta_time) * 1000000)', 2)} AS spent_sec
  FROM samples GROUP BY sample_time, event""")
def _(t):
    return A.sample_events(t.samples)


@query("a02_sample_totals", f"""SELECT sample_time, count(*) AS sessions, {rounded('sum(delta_read_io_bytes)', '1048576')} AS read_mb,
    {rounded('sum(delta_write_io_bytes)', '1048576')} AS write_mb, CAST(sum(delta_read_io_requests) AS BIGINT) AS read_requests,
    CAST(sum(delta_write_io_requests) AS BIGINT) AS write_requests, {rounded('sum(pga_allocated)', '1073741824', 3)} AS pga_gb,
    {rounded('max(pga_allocated)', '1048576', 1)} AS pga_max_mb, {rounded('sum(temp_space_allocated)', '1073741824', 3)} AS temp_gb,
    {rounded('max(temp_space_allocated)', '1048576', 1)} AS temp_max_mb
  FROM samples GROUP BY sample_time""")
def _(t):
    return A.sample_totals(t.samples)


def _classes(render):
    return ", ".join(f"{render(c)} AS {k}" for k, c in CLASSES)


BY_CLASS = "count(*) AS total, count(DISTINCT sample_id) AS snapshots, count(*) FILTER (WHERE session_state = 'ON CPU') AS on_cpu, " \
           + rounded("sum(tm_delta_cpu_time)", "1000000", 1) + " AS cpu_sec"


@query("a03_by_wait_class", f"""SELECT strftime(sample_time, '%Y-%m-%d') AS sample_date, strftime(sample_time, '%H:%M:%S') AS sample_clock, {BY_CLASS},
    {_classes(lambda c: f"count(*) FILTER (WHERE wait_class = '{c}')")} FROM samples GROUP BY 1, 2""")
def _(t):
    return A.by_wait_class(t.samples)


@query("a04_average_by_wait_class", f"""SELECT strftime(sample_time, '%Y-%m-%d') AS sample_date, strftime(sample_time, '%H:%M') AS sample_clock, {BY_CLASS},
    {_classes(lambda c: rounded(f"count(*) FILTER (WHERE wait_class = '{c}')", "count(DISTINCT sample_id)"))} FROM samples GROUP BY 1, 2""")
def _(t):
    return A.by_wait_class(t.samples, MINUTE, average=True)


@query("a05_conditional_profile", f"""SELECT sample_time, count(*) FILTER (WHERE event = 'log file sync') AS on_sync, count(*) FILTER (WHERE event = 'latch free' AND p2 = 467) AS on_latch_467,
    count(*) FILTER (WHERE force_matching_signature = 10602832839598511493) AS big_signature,
    CAST(sum(delta_read_io_bytes) FILTER (WHERE action LIKE 'ORA$AT_OS_OPT_SY%') AS BIGINT) AS statistics_read,
    avg(nullif(time_waited, 0)) FILTER (WHERE event = 'log file sync') AS sync_wait_us FROM samples GROUP BY sample_time""")
def _(t):
    e = F.col("event")
    return A.conditional_profile(t.samples, {
        "on_sync": numbers.count_if(e == "log file sync"),
        "on_latch_467": numbers.count_if((e == "latch free") & (F.col("p2") == 467)),
        "big_signature": numbers.count_if(F.col("force_matching_signature") == F.lit("10602832839598511493").cast("decimal(20,0)")),
        "statistics_read": numbers.sum_if(F.col("action").like("ORA$AT_OS_OPT_SY%"), "delta_read_io_bytes"),
        "sync_wait_us": numbers.avg_nz(F.when(e == "log file sync", F.col("time_waited"))),
    })


@query("a06_mean_without_zeros", "SELECT event, avg(nullif(time_waited, 0)) AS mean_us FROM samples GROUP BY event")
def _(t):
    return t.samples.groupBy("event").agg(numbers.avg_nz("time_waited").alias("mean_us"))


def _writer_sql(like, centis):
    mb = rounded("sum(delta_write_io_bytes)", "1048576")
    return f"""SELECT sample_time, event, processes, centis / CAST(100 AS DOUBLE) AS spent_sec, written_mb, write_requests,
      {rounded('written_mb * 100', 'centis')} AS written_mb_sec, {rounded('write_requests * 100', 'centis')} AS write_requests_sec, waited_ms FROM (
      SELECT sample_time, max(event) AS event, count(*) AS processes, {centis} AS centis, {mb} AS written_mb,
        CAST(sum(delta_write_io_requests) AS BIGINT) AS write_requests,
        {rounded('sum(nullif(time_waited, 0))', '(count(nullif(time_waited, 0)) * 1000)', 1)} AS waited_ms
      FROM samples WHERE program LIKE '{like}' GROUP BY sample_time) w"""


@query("a07_writer_throughput", _writer_sql("%LG%", rounded("sum(delta_time)", "(count(delta_time) * 10000)")))
def _(t):
    return A.writer_stats(t.samples, "%LG%")


@query("a07_writer_throughput_summed", _writer_sql("%DBW%", rounded("sum(delta_time)", "10000")))
def _(t):
    return A.writer_stats(t.samples, "%DBW%", divisor="sum")


TOP_ACTIVITY = """count(*) FILTER (WHERE session_state = 'ON CPU') AS on_cpu,
    count(*) FILTER (WHERE session_state = 'WAITING' AND wait_class IS DISTINCT FROM 'User I/O') AS in_wait,
    count(*) FILTER (WHERE session_state = 'WAITING' AND wait_class = 'User I/O') AS on_io, count(*) AS total"""


@query("a08_top_activity", f"SELECT strftime(sample_time, '%d.%m.%Y %H') AS hour, user_id, program, machine, module, action, {TOP_ACTIVITY} FROM samples GROUP BY ALL")
def _(t):
    hour = F.date_format("sample_time", "dd.MM.yyyy HH").alias("hour")
    return A.top_activity(t.samples, [hour, "user_id", "program", "machine", "module", "action"])


@query("a09_average_active", f"SELECT sql_id, {rounded('count(*) * 10', '1296000', 1)} AS aas FROM samples WHERE sample_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY sql_id")
def _(t):
    return P.between_time(t.samples, START, END).groupBy("sql_id").agg(A.average_active(F.count(F.lit(1)), 15 * 86400, 10).alias("aas"))


@query("a10_distinct_executions", """SELECT sql_id, count(DISTINCT coalesce(strftime(sql_exec_start, '%Y-%m-%d %H:%M:%S'), '') || ':' || coalesce(CAST(sql_exec_id AS VARCHAR), '')) AS executions
  FROM samples GROUP BY sql_id""")
def _(t):
    return t.samples.groupBy("sql_id").agg(A.distinct_executions().alias("executions"))


@query("a11_first_last_seen", "SELECT session_id, strftime(min(sample_time), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(sample_time), '%Y-%m-%d %H:%M:%S') AS last_seen FROM samples GROUP BY session_id")
def _(t):
    seen = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return t.samples.groupBy("session_id").agg(seen(F.min("sample_time")).alias("first_seen"), seen(F.max("sample_time")).alias("last_seen"))


@query("a16_count_by", "SELECT force_matching_signature, count(*) AS cnt FROM samples WHERE sample_time > TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1")
def _(t):
    return A.count_by(P.last(t.samples, AS_OF, "24 hours"), ["force_matching_signature"])


@query("a17_weighted_total", f"""SELECT event, sql_id, samples, avg_wait_ms, avg_wait_ms * samples AS total_ms FROM (
  SELECT event, sql_id, count(*) AS samples, {rounded('sum(time_waited)', '(count(time_waited) * 1000)')} AS avg_wait_ms FROM samples GROUP BY 1, 2) w""")
def _(t):
    return A.weighted_total(t.samples, ["event", "sql_id"])


@query("a18_waiters", """SELECT w.*, s.sql_text FROM (SELECT sample_time, inst_id, blocking_session, event, wait_class, current_obj, sql_id, max(session_id) AS one_waiter, count(*) AS cnt
  FROM samples WHERE event = 'library cache lock' GROUP BY ALL) w LEFT JOIN statements s ON s.sql_id = w.sql_id""")
def _(t):
    held = A.waiters(t.samples.where("event = 'library cache lock'"), ["sample_time", "inst_id", "blocking_session", "event", "wait_class", "current_obj", "sql_id"])
    return J.scalar_lookup(held, t.statements, "sql_id", "sql_text", "sql_text")


@query("a19_waits_impact", f"""SELECT event, wait_class, in_parse, sql_id, count(DISTINCT session_id) AS sessions_affected, {rounded('sum(time_waited)', '1000000')} AS waited_sec
  FROM samples WHERE event LIKE 'library cache%' GROUP BY event, wait_class, in_parse, sql_id""")
def _(t):
    return A.waits_impact(t.samples.where("event LIKE 'library cache%'"), ["event", "wait_class", "in_parse", "sql_id"])


@query("a26_event_list_with_label", """SELECT sample_time, string_agg(coalesce(event, 'ON CPU'), ', ' ORDER BY coalesce(event, 'ON CPU')) AS events
  FROM samples WHERE program LIKE '%(LG%' GROUP BY sample_time""")
def _(t):
    from ..operators.aggregates import agg_list
    return t.samples.where("program LIKE '%(LG%'").groupBy("sample_time").agg(agg_list(F.coalesce("event", F.lit("ON CPU")), ", ").alias("events"))

# ---- ranking -----------------------------------------------------------------------------

@query("w01_rank_with_ties", """SELECT sample_time, event, sessions, CAST(rank() OVER (PARTITION BY sample_time ORDER BY sessions DESC NULLS FIRST, avg_wait_us DESC NULLS FIRST) AS INTEGER) AS rnk
  FROM (SELECT sample_time, event, count(*) AS sessions, avg(nullif(time_waited, 0)) AS avg_wait_us FROM samples GROUP BY 1, 2) e""")
def _(t):
    events = A.sample_events(t.samples)
    return topn.rank_in(events, ["sample_time"], [desc("sessions"), desc("avg_wait_us")], "rank").select("sample_time", "event", "sessions", "rnk")


def _top_n_sql(source, key, order, cols, n, fn="row_number"):
    wide = ", ".join(f"min({c}) FILTER (WHERE rnk = {k}) AS top{k}_{c}" for k in range(1, n + 1) for c in cols)
    return f"SELECT {key}, {wide} FROM (SELECT *, {fn}() OVER (PARTITION BY {key} ORDER BY {order}) AS rnk FROM ({source}) e) r WHERE rnk <= {n} GROUP BY {key}"


EVENT_AGG = "SELECT {key}, event, count(*) AS sessions, avg(nullif(time_waited, 0)) AS avg_wait_us, " \
            + rounded("sum(nullif(time_waited, 0))", "(count(nullif(time_waited, 0)) * 1000)", 1) + " AS avg_wait_ms FROM samples {where} GROUP BY 1, 2"
EVENT_ORDER = "sessions DESC NULLS FIRST, avg_wait_us DESC NULLS FIRST, event ASC NULLS LAST"


@query("j01_top_n_side_by_side", _top_n_sql(EVENT_AGG.format(key="sample_time", where=""), "sample_time", EVENT_ORDER, ["event", "sessions", "avg_wait_ms"], 3))
def _(t):
    return A.top_events(t.samples, 3)


@query("j01_top_n_shared_ranks", _top_n_sql("SELECT sample_time, event, count(*) AS sessions FROM samples WHERE event IS NOT NULL GROUP BY 1, 2", "sample_time", "sessions DESC", ["event", "sessions"], 2, "rank"))
def _(t):
    events = A.count_by(t.samples.where("event IS NOT NULL"), ["sample_time", "event"], "sessions")
    return topn.top_n_wide(events, ["sample_time"], ["event", "sessions"], [desc("sessions")], 2, ties="rank")


@query("w05_share_of_total", """SELECT event, cnt, lpad(CAST(CAST((2 * 100 * cnt + sum(cnt) OVER ()) // (2 * sum(cnt) OVER ()) AS BIGINT) AS VARCHAR) || '%', 5, ' ') AS share
  FROM (SELECT event, count(*) AS cnt FROM samples GROUP BY event) c""")
def _(t):
    return with_total(A.count_by(t.samples, ["event"]), "cnt").withColumn("share", numbers.share("cnt", "total")).drop("total")


@query("t01_sort_with_null_placement", "SELECT session_id, sample_id, temp_space_allocated FROM samples")
def _(t):
    return t.samples.select("session_id", "sample_id", "temp_space_allocated") \
        .orderBy(F.col("temp_space_allocated").desc_nulls_last(), asc("sample_id"), asc("session_id"))


@query("t02_top_k", "SELECT session_id, count(*) AS cnt FROM samples GROUP BY session_id ORDER BY cnt DESC, session_id LIMIT 9")
def _(t):
    return topn.top_k(A.count_by(t.samples, ["session_id"]), [F.col("cnt").desc(), asc("session_id")], 9)

# ---- functions ---------------------------------------------------------------------------

HEX = "CASE WHEN session_state = 'WAITING' THEN lpad(upper(to_hex({c})), 16, '0') END AS {c}hex"
_ROLE = r"regexp_extract(coalesce(program, ''), '\([^(]*$')"
PROGRAM_LABEL = rf"""regexp_replace(CASE WHEN session_type = 'BACKGROUND' OR regexp_matches({_ROLE}, '^\([JP]\d+\)') THEN coalesce(nullif({_ROLE}, ''), program, '')
    ELSE '(' || split_part(coalesce(program, ''), '@', 1) || ')' END, '\d', 'n', 'g') || ' '"""
CLASS_NAMES = ", ".join(f"'{c}'" for c in BUFFER_CLASSES)
EVENT_TEXT = f"""coalesce(event, session_state) || CASE WHEN starts_with(event, 'buffer busy') OR starts_with(event, 'gc buffer busy') THEN ' [' ||
    coalesce(CASE WHEN p3 BETWEEN 0 AND {len(BUFFER_CLASSES)} THEN ([{CLASS_NAMES}])[p3] ELSE 'undo ' || if(p3 % 2 = 1, 'header', 'data') END, '') || ']' ELSE '' END"""


@query("f08_program_labels", f"SELECT program, session_type, {PROGRAM_LABEL} AS program_role, count(*) AS cnt FROM samples GROUP BY 1, 2, 3")
def _(t):
    return A.count_by(t.samples, ["program", "session_type", text.program_label("program", "session_type").alias("program_role")])


@query("f09_event_labels_with_buffer_class", f"SELECT {EVENT_TEXT} AS event_text, p3, count(*) AS cnt FROM samples GROUP BY 1, 2")
def _(t):
    return A.count_by(t.samples, [labels.event_label("event", "session_state", "p3", BUFFER_CLASSES).alias("event_text"), "p3"])


@query("f03_hex_parameters", f"SELECT sample_id, session_id, {HEX.format(c='p1')}, {HEX.format(c='p3')} FROM samples")
def _(t):
    return R.ash_dimensions(t.samples, BUFFER_CLASSES).select("sample_id", "session_id", "p1hex", "p3hex")


@query("j27_buffer_class_lookup", f"""SELECT p3, CASE WHEN p3 <= {len(BUFFER_CLASSES)} THEN CASE WHEN p3 >= 1 THEN ([{CLASS_NAMES}])[CAST(p3 AS INT)] END
    WHEN ((p3 & 65535) - 17) % 2 = 0 THEN 'undo header' WHEN ((p3 & 65535) - 17) % 2 = 1 THEN 'undo data' ELSE 'error' END AS class, count(*) AS cnt FROM samples GROUP BY 1, 2""")
def _(t):
    return A.count_by(t.samples, ["p3", labels.buffer_class("p3", BUFFER_CLASSES).alias("class")])


@query("w06_ordinal_lookup", f"SELECT sample_id, session_id, p3, CASE WHEN p3 BETWEEN 1 AND {len(BUFFER_CLASSES)} THEN ([{CLASS_NAMES}])[CAST(p3 AS INT)] END AS class FROM samples")
def _(t):
    return J.ordinal_lookup(t.samples.select("sample_id", "session_id", "p3"), "p3", BUFFER_CLASSES, "class")

# ---- reports -----------------------------------------------------------------------------

def _sum(c):
    return f"CAST(sum({c}) AS BIGINT)"


def _per_sample_sql(measures, report, n, order, cpu, where="", source_order=EVENT_ORDER):
    tops = ", ".join(f"coalesce(t.top{k}_event, '{cpu}') AS top{k}_event, t.top{k}_sessions, t.top{k}_avg_wait_ms" for k in range(1, n + 1))
    top = _top_n_sql(EVENT_AGG.format(key="sample_time", where=where), "sample_time", order, ["event", "sessions", "avg_wait_ms"], n)
    return f"""SELECT m.sample_time, strftime(m.sample_time, '%H:%M:%S') AS clock, {report}, {tops}
      FROM (SELECT sample_time, count(*) AS sessions, {measures} FROM samples {where} GROUP BY sample_time) m JOIN ({top}) t ON t.sample_time = m.sample_time"""


def _writer_measures(p, like):
    f = f"FILTER (WHERE program LIKE '{like}')"
    return f"""nullif(count(*) {f}, 0) AS {p}_sessions, {rounded(f"(sum(delta_time) {f})", f"(count(delta_time) {f} * 10000)")} AS {p}_centis,
      (sum(nullif(time_waited, 0)) {f}) AS {p}_waited, (count(nullif(time_waited, 0)) {f}) AS {p}_waited_n,
      (sum(delta_read_io_bytes) {f}) AS {p}_read, (sum(delta_write_io_bytes) {f}) AS {p}_written,
      CAST(sum(delta_write_io_requests) {f} AS BIGINT) AS {p}_writes, CAST(sum(delta_read_io_requests) {f} AS BIGINT) AS {p}_reads"""


def _mb_sec(p, c, scale=0):
    return rounded(f"{rounded(f'{p}_{c} * {10 ** scale}', '1048576')} * 100", f"({p}_centis * {10 ** scale})")


IO = f"{_sum('delta_read_io_bytes')} AS rb, {_sum('delta_write_io_bytes')} AS wb, {_sum('delta_read_io_requests')} AS read_requests, {_sum('delta_write_io_requests')} AS write_requests"
IO_REPORT = f"{rounded('rb', '1048576')} AS read_mb, {rounded('wb', '1048576')} AS write_mb, read_requests, write_requests"


@query("r01_top2_with_redo", _per_sample_sql(
    f"{IO}, max(event) FILTER (WHERE program LIKE '%LGWR%') AS lgw_event, {_writer_measures('lgw', '%LGWR%')}",
    f"m.sessions, {IO_REPORT}, {_mb_sec('lgw', 'written')} AS lgw_mb_sec, lgw_event, {rounded('lgw_waited', '(lgw_waited_n * 1000)', 1)} AS lgw_waited_ms",
    2, EVENT_ORDER, "On CPU"))
def _(t):
    return R.top2_with_redo(t.samples)


SNAPS = "WHERE snap_id BETWEEN 740790 AND 740805"


@query("r02_top3_with_both_writers", _per_sample_sql(
    f"{_sum('pga_allocated')} AS pga, {IO}, {_writer_measures('lgw', '%LG%')}, {_writer_measures('dbw', '%DBW%')}",
    f"m.sessions, {rounded('pga', '1048576')} AS pga_mb, {IO_REPORT}, CASE WHEN m.sessions > 15 THEN '!!!!!!!' ELSE ' ' END AS warning, "
    + ", ".join(f"{p}_centis / CAST(100 AS DOUBLE) AS {p}_spent_sec, {rounded(f'{p}_writes * 100', f'{p}_centis')} AS {p}_write_requests_sec, {_mb_sec(p, 'written')} AS {p}_mb_sec, {p}_sessions" for p in ("lgw", "dbw")),
    3, "sessions DESC, event ASC NULLS LAST", "on CPU", SNAPS))
def _(t):
    return R.top3_with_writers(P.snap_filter(t.samples, (740790, 740805)), busy=15)


@query("r03_activity_by_dimensions", f"""SELECT total_seconds, {rounded('total_seconds', '1296000', 1)} AS aas,
    lpad(CAST(CAST((200 * total_seconds + sum(total_seconds) OVER ()) // (2 * sum(total_seconds) OVER ()) AS BIGINT) AS VARCHAR) || '%', 5, ' ') AS share,
    username, program_role, event_text, objt, first_seen, last_seen, executions FROM (
  SELECT count(*) AS total_seconds, u.username, {PROGRAM_LABEL} AS program_role, {EVENT_TEXT} AS event_text, o.objt,
    strftime(min(sample_time), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(sample_time), '%Y-%m-%d %H:%M:%S') AS last_seen,
    count(DISTINCT coalesce(strftime(sql_exec_start, '%Y-%m-%d %H:%M:%S'), '') || ':' || coalesce(CAST(sql_exec_id AS VARCHAR), '')) AS executions
  FROM samples s LEFT JOIN users u ON u.user_id = s.user_id LEFT JOIN (SELECT object_id, owner || '.' || object_name || ' [' || object_type || ']' AS objt FROM objects) o ON o.object_id = s.current_obj
  WHERE sample_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AND session_type = 'FOREGROUND' GROUP BY 2, 3, 4, 5) g
  ORDER BY total_seconds DESC, username ASC NULLS LAST, program_role ASC NULLS LAST, event_text ASC NULLS LAST, objt ASC NULLS LAST LIMIT 15""")
def _(t):
    return R.activity_report(t.samples, ["username", "program_role", "event_text", "objt"], "session_type = 'FOREGROUND'", START, END,
                             users=t.users, objects=t.objects, classes=BUFFER_CLASSES)


@query("r03_activity_archive_weight", f"""SELECT total_seconds * 10 AS total_seconds, {rounded('total_seconds * 10', '1296000', 1)} AS aas,
    lpad(CAST(CAST((200 * total_seconds + sum(total_seconds) OVER ()) // (2 * sum(total_seconds) OVER ()) AS BIGINT) AS VARCHAR) || '%', 5, ' ') AS share,
    sql_id, first_seen, last_seen, executions FROM (SELECT count(*) AS total_seconds, sql_id,
    strftime(min(sample_time), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(sample_time), '%Y-%m-%d %H:%M:%S') AS last_seen,
    count(DISTINCT coalesce(strftime(sql_exec_start, '%Y-%m-%d %H:%M:%S'), '') || ':' || coalesce(CAST(sql_exec_id AS VARCHAR), '')) AS executions
  FROM samples WHERE sample_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY sql_id) g ORDER BY g.total_seconds DESC, sql_id LIMIT 15""")
def _(t):
    return R.activity_report(t.samples, ["sql_id"], None, START, END, weight=10)


SIGNATURES = ["4479854810611774685", "6199011555372230014", "10602832839598511493", "7722310109089591007"]


def _profile_sql():
    cnt = lambda cond: f"count(*) FILTER (WHERE {cond})"
    m = [f"{cnt('event IS NULL')} AS on_cpu"]
    m += [f"{cnt(f'wait_class = {c!r}')} AS class_{c.lower()}" for c in R.PROFILE_CLASSES]
    m += [f"{cnt(chr(39).join(['in_hard_parse = ', 'Y', '']))} AS in_hard_parse", f"{cnt(chr(39).join(['in_parse = ', 'Y', '']))} AS in_parse"]
    m += [f"{cnt(f'event = {e!r}')} AS on_{k}" for k, e in R.PROFILE_EVENTS.items()]
    m += [f"{cnt(f'event = {chr(39)}latch free{chr(39)} AND p2 = {p}')} AS on_latch_free_{p}" for p in R.PROFILE_LATCHES]
    m += [f"{cnt(f'force_matching_signature = {x}')} AS signature_{x}" for x in SIGNATURES]
    dbw = "program LIKE '%(DBW%'"
    m += [f"CASE WHEN {cnt(dbw)} > 0 THEN {cnt(dbw + ' AND event IS NULL')} END AS dbw_on_cpu"]
    m += [f"CASE WHEN {cnt(dbw)} > 0 THEN {cnt(dbw + f' AND event = {e!r}')} END AS dbw_on_{k}" for k, e in R.PROFILE_DB_WRITER_EVENTS.items()]
    names = [x.rsplit(" AS ", 1)[1] for x in m]
    stats = "action LIKE 'ORA$AT_OS_OPT_SY%'"
    m += [f"nullif({cnt(stats)}, -1) AS statistics_sessions", f"(sum(delta_read_io_bytes) FILTER (WHERE {stats})) AS stats_read"]
    for k, e in R.PROFILE_WAITS.items():
        m += [f"(sum(nullif(time_waited, 0)) FILTER (WHERE event = '{e}')) AS w_{k}", f"(count(nullif(time_waited, 0)) FILTER (WHERE event = '{e}')) AS n_{k}"]
    m += [IO, f"{_sum('temp_space_allocated')} AS temp, max(temp_space_allocated) AS temp_max, {_sum('pga_allocated')} AS pga, max(pga_allocated) AS pga_max",
          _writer_measures("lgw", "%(LG%"), _writer_measures("dbw", "%(DBW%"),
          "string_agg(coalesce(event, 'ON CPU'), ', ' ORDER BY coalesce(event, 'ON CPU')) FILTER (WHERE program LIKE '%(LG%') AS lgw_events"]
    report = ["m.sessions", *names, "statistics_sessions", f"{rounded('stats_read', '1048576')} AS statistics_read_mb"]
    report += [f"{rounded(f'w_{k}', f'(n_{k} * 1000)', 1)} AS avg_{k}_ms" for k in R.PROFILE_WAITS]
    report += [IO_REPORT, f"{rounded('dbw_written', '1048576')} AS dbw_write_mb", "dbw_writes AS dbw_write_requests",
               f"{rounded('temp', '1073741824', 1)} AS temp_gb, {rounded('temp_max', '1048576', 1)} AS temp_max_mb, {rounded('pga', '1073741824', 1)} AS pga_gb, {rounded('pga_max', '1048576', 1)} AS pga_max_mb",
               f"{_mb_sec('lgw', 'written', 2)} AS lgw_written_mb_sec, {_mb_sec('lgw', 'read', 2)} AS lgw_read_mb_sec, lgw_events, {rounded('lgw_waited', '(lgw_waited_n * 1000)', 1)} AS lgw_waited_ms",
               f"lgw_writes AS lgw_write_requests, {rounded('lgw_writes * 100', 'lgw_centis')} AS lgw_write_requests_sec, lgw_reads AS lgw_read_requests, lgw_sessions, lgw_centis / CAST(100 AS DOUBLE) AS lgw_spent_sec",
               f"{_mb_sec('dbw', 'written', 2)} AS dbw_written_mb_sec, {_mb_sec('dbw', 'read', 2)} AS dbw_read_mb_sec, {rounded('dbw_waited', '(dbw_waited_n * 1000)', 1)} AS dbw_waited_ms",
               f"{rounded('dbw_writes * 100', 'dbw_centis')} AS dbw_write_requests_sec, {rounded('dbw_reads * 100', 'dbw_centis')} AS dbw_read_requests_sec, dbw_sessions"]
    return _per_sample_sql(", ".join(m), ", ".join(report), 5, EVENT_ORDER, "On CPU")


@query("r04_wide_profile", _profile_sql())
def _(t):
    return R.wide_profile(t.samples, SIGNATURES)


WAITING = "SELECT sample_time, event, count(*) AS sessions FROM samples WHERE session_state = 'WAITING' GROUP BY 1, 2"


@query("r05_top5_waiting_events", f"SELECT *, strftime(sample_time, '%H:%M:%S') AS clock FROM ({_top_n_sql(WAITING, 'sample_time', 'sessions DESC, event ASC NULLS LAST', ['event', 'sessions'], 5)}) w")
def _(t):
    return R.top5_waiting(t.samples)


@query("r06_top2_statement_lines", f"""SELECT m.sample_time, strftime(m.sample_time, '%H:%M:%S') AS clock, m.sessions, t.* EXCLUDE (sample_time, top2_earliest_start, top2_read_mb_sec) FROM
  (SELECT sample_time, count(*) AS sessions FROM samples WHERE wait_class = 'Concurrency' GROUP BY 1) m JOIN ({_top_n_sql('''
    SELECT sample_time, sql_id, sql_plan_hash_value, sql_plan_line_id, sql_plan_operation, sql_plan_options,
      sql_id || ' - ' || sql_plan_hash_value || ', plan line - ' || sql_plan_line_id || ', plan operation - ' || sql_plan_operation || ' ' || coalesce(sql_plan_options, '') AS line,
      count(*) AS sessions, count(*) FILTER (WHERE in_sql_execution = 'Y') AS executing, count(*) FILTER (WHERE in_hard_parse = 'Y') AS hard_parsing,
      strftime(min(sql_exec_start), '%H:%M:%S') AS earliest_start, ''' + rounded('sum(delta_read_io_bytes) * count(delta_time) * 1000000', '(sum(delta_time) * 1048576)', 2) + ''' AS read_mb_sec
    FROM samples WHERE wait_class = 'Concurrency' GROUP BY 1, 2, 3, 4, 5, 6''', 'sample_time',
    'sessions DESC, sql_id, sql_plan_hash_value, sql_plan_line_id, sql_plan_operation, sql_plan_options NULLS LAST',
    ['line', 'sessions', 'executing', 'hard_parsing', 'earliest_start', 'read_mb_sec'], 2)}) t ON t.sample_time = m.sample_time""")
def _(t):
    return R.top2_statement_lines(t.samples.where("wait_class = 'Concurrency'"))


@query("r07_wait_history_top3", _top_n_sql(f"""SELECT seq_no, event, count(*) AS sessions, sum(wait_time_micro) AS waited,
    {rounded('sum(wait_time_micro)', '(count(wait_time_micro) * 1000)', 1)} AS avg_wait_ms,
    {rounded('sum(time_since_last_wait_micro)', '(count(time_since_last_wait_micro) * 1000)', 1)} AS avg_since_last_ms FROM wait_history
  WHERE event NOT IN ('SQL*Net message from client', 'rdbms ipc message', 'SQL*Net break/reset to client') AND event NOT LIKE '%idle wait'
    AND NOT (event IN ('SQL*Net message to client', 'SQL*Net more data from client') AND wait_time_micro < 1000) GROUP BY 1, 2""",
    "seq_no", "sessions DESC, waited DESC, event", ["event", "sessions", "avg_wait_ms", "avg_since_last_ms"], 3))
def _(t):
    return R.wait_history_top3(t.wait_history)


def _day_sql(day, start, end):
    cols = ", ".join(f"{rounded(f'count(*) FILTER (WHERE wait_class = {c!r})', 'count(DISTINCT sample_id)')} AS day{day}_{k}" for k, c in CLASSES)
    return f"""SELECT strftime(sample_time, '%H:%M') AS sample_clock, count(DISTINCT sample_id) AS day{day}_snapshots, {cols} FROM samples
      WHERE sample_time BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{end}' GROUP BY strftime(sample_time, '%Y-%m-%d'), 1"""


DAY1, DAY2 = ("2024-01-08 08:00:00", "2024-01-08 15:30:00"), ("2024-01-15 10:00:00", "2024-01-15 18:30:00")


@query("r08_wait_classes_two_days", f"SELECT * FROM ({_day_sql(1, *DAY1)}) a FULL JOIN ({_day_sql(2, *DAY2)}) b USING (sample_clock)")
def _(t):
    return R.wait_class_day_compare(t.samples, DAY1, DAY2)


@query("r11_top_sessions", f"""SELECT CASE WHEN l.sid IS NULL THEN 'DISCONNECTED' ELSE 'CONNECTED' END AS status, session_id, u.username, b.program, on_cpu, in_wait, on_io, total
  FROM (SELECT session_id, session_serial, user_id, program, {TOP_ACTIVITY} FROM samples GROUP BY ALL
    ORDER BY total DESC, session_id, session_serial, user_id, program LIMIT 9) b JOIN users u ON u.user_id = b.user_id
  LEFT JOIN sessions l ON l.sid = session_id AND l.serial = session_serial""")
def _(t):
    return R.top_sessions(t.samples, t.users, t.sessions)


@query("j28_live_sessions_in_last_sample", """SELECT l.wait_class, l.status, s.event, count(*) AS cnt FROM sessions l JOIN samples s ON s.session_id = l.sid
  WHERE s.sample_time = (SELECT max(sample_time) FROM samples) GROUP BY 1, 2, 3""")
def _(t):
    return J.live_vs_sample(t.sessions, t.samples)


@query("j32_samples_of_statement_text", "SELECT sample_id, session_id, s.sql_id, sql_text FROM samples s JOIN statements q ON q.sql_id = s.sql_id WHERE sql_text LIKE '%red%'")
def _(t):
    return J.samples_of_text(t.samples, t.statements, "%red%").select("sample_id", "session_id", "sql_id", "sql_text")


@query("j02_optional_dimension", "SELECT sample_id, session_id, u.username, u.profile FROM samples s LEFT JOIN users u ON u.user_id = s.user_id")
def _(t):
    return J.enrich(t.samples, t.users, "user_id").select("sample_id", "session_id", "username", "profile")


@query("a31_execution_spans", """SELECT sql_exec_id, sql_exec_start, module, session_id, min(sample_time) AS started, max(sample_time) AS ended,
    date_diff('second', min(sample_time), max(sample_time)) AS elapsed_sec FROM samples WHERE sql_id = 'q7' GROUP BY 1, 2, 3, 4""")
def _(t):
    return A.exec_spans(t.samples.where("sql_id = 'q7'"))


@query("a32_execution_waits", f"""SELECT sql_exec_start, coalesce(event, 'ON CPU') AS wait_event, count(*) AS samples, {rounded('sum(tm_delta_time)', '1000000')} AS tm_delta_sec,
    {rounded('sum(delta_time)', '1000000')} AS delta_sec, date_diff('second', min(sample_time), max(sample_time)) AS elapsed_sec FROM samples WHERE sql_id = 'q7' GROUP BY 1, 2""")
def _(t):
    return A.exec_waits(t.samples.where("sql_id = 'q7'"))


PARALLEL = f"""SELECT coalesce(qc_session_id, session_id) AS session_id, px_flags, sql_exec_id, sql_exec_start, coalesce(event, 'ON CPU') AS wait_event, count(*) AS samples,
    {rounded('sum(tm_delta_cpu_time)', '1000000')} AS cpu_sec, {rounded('sum(tm_delta_db_time)', '1000000')} AS db_sec,
    date_diff('second', min(sample_time), max(sample_time)) AS elapsed_sec, {rounded('px_flags', '2097152')} AS degree
  FROM samples WHERE sql_id IN ('q7', 'q9') GROUP BY 1, 2, 3, 4, 5"""


@query("a33_parallel_executions", PARALLEL)
def _(t):
    return A.exec_parallel(t.samples.where(F.col("sql_id").isin("q7", "q9")))


@query("r34_execution_report", """SELECT w.sql_exec_start, w.wait_event, w.samples, x.executions FROM
  (SELECT sql_exec_start, coalesce(event, 'ON CPU') AS wait_event, count(*) AS samples FROM samples WHERE sql_id = 'q7' GROUP BY 1, 2) w LEFT JOIN
  (SELECT sql_exec_start, count(*) AS executions FROM (SELECT DISTINCT sql_exec_id, sql_exec_start, module, session_id FROM samples WHERE sql_id = 'q7') e GROUP BY 1) x
  ON x.sql_exec_start = w.sql_exec_start""")
def _(t):
    mine = t.samples.where("sql_id = 'q7'")
    spans = A.count_by(A.exec_spans(mine), ["sql_exec_start"], "executions")
    return A.exec_waits(mine).join(spans, "sql_exec_start", "left").select("sql_exec_start", "wait_event", "samples", "executions")
