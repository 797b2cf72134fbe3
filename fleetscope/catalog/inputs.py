"""Input relations derived from the shared test tables.

Each view is one portable SELECT: Spark runs it to feed an operator (or its form in FRAMES, which gives the
same rows), and the expected-result SQL embeds the same text. `{name}` refers to a test table or an earlier view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {}

# One row per (sample_id, inst_id, session_id). Blockers: mostly the previous session of the
# sample, sometimes the next one (which closes cycles), sometimes one that is not sampled. Time and
# snapshot are computed innermost and partition both windows, so filters on them reach the scan.
VIEWS["samples"] = """
SELECT sample_id, sample_time, snap_id, inst_id, session_id, session_serial, session_type, event, wait_class,
  session_state, time_waited, program, module, action, machine, user_id, p1, p2, p3,
  sql_id, sql_plan_hash_value, sql_plan_line_id, sql_plan_operation, sql_plan_options, sql_exec_id, sql_exec_start,
  force_matching_signature, in_parse, in_hard_parse, in_sql_execution, current_obj, seq_no,
  blocking_session, 1 + blocking_session % 2 AS blocking_inst_id, blocking_session * 7 + 1 AS blocking_session_serial,
  CASE WHEN event IS NOT NULL AND event_id % 17 = 0 THEN 'Y' ELSE 'N' END AS hangchain_info,
  CASE WHEN program LIKE '%(P003)' THEN session_id - session_id % 10 END AS qc_session_id,
  2097152 * (event_id % 4) + event_id % 100 AS px_flags,
  1000000 * (1 + event_id % 3) AS delta_time, 900000 * (1 + event_id % 3) AS tm_delta_time,
  CASE WHEN event IS NULL THEN 800000 ELSE 10000 END AS tm_delta_cpu_time,
  100000 * (1 + event_id % 7) AS tm_delta_db_time,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE units * 70000 END AS delta_read_io_bytes,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE units * 30000 END AS delta_write_io_bytes,
  units AS delta_read_io_requests, CASE WHEN event_id % 4 = 0 THEN NULL ELSE units * 2 END AS delta_write_io_requests,
  units * 40000 AS pga_allocated, CASE WHEN event_id % 3 = 0 THEN units * 90000 END AS temp_space_allocated
FROM (
  SELECT b.*, CASE WHEN event IS NULL THEN NULL WHEN event_id % 11 = 0 THEN 1000000 + session_id
      WHEN event_id % 13 = 0 THEN lead(session_id) OVER (PARTITION BY sample_time, snap_id, sample_id ORDER BY session_id)
      ELSE lag(session_id) OVER (PARTITION BY sample_time, snap_id, sample_id ORDER BY session_id) END AS blocking_session
  FROM (
    SELECT event_id, sample_id, sample_time, snap_id,
      1 + user_id % 2 AS inst_id, user_id AS session_id, user_id * 7 + 1 AS session_serial,
      CASE WHEN user_id % 5 < 2 THEN 'BACKGROUND' ELSE 'FOREGROUND' END AS session_type,
      CASE event_type
        WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'db file scattered read' ELSE 'db file sequential read' END
        WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'log file parallel write' ELSE 'log file sync' END
        WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'library cache: mutex X' WHEN 1 THEN 'enq: TX - index contention'
                               ELSE 'library cache lock' END
        WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'latch free' ELSE 'buffer busy waits' END END AS event,
      CASE event_type WHEN 'click' THEN 'User I/O' WHEN 'purchase' THEN 'Commit' WHEN 'error' THEN 'Concurrency'
        WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'Other' ELSE 'Network' END END AS wait_class,
      CASE WHEN event_type = 'view' THEN 'ON CPU' ELSE 'WAITING' END AS session_state,
      CASE WHEN event_type = 'view' OR event_id % 5 = 0 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) * 1000 END AS time_waited,
      CASE user_id % 5 WHEN 0 THEN 'db@h1 (LGWR)' WHEN 1 THEN 'db@h1 (DBW0)' WHEN 2 THEN 'db@h1 (P003)'
        WHEN 3 THEN CASE WHEN event_id % 41 <> 0 THEN 'app12@h2 (TNS V1-V3)' END ELSE 'batch@h3 (J001)' END AS program,
      concat('mod', CAST(user_id % 3 AS STRING)) AS module,
      CASE WHEN event_id % 19 = 0 THEN 'ORA$AT_OS_OPT_SY_1' ELSE concat('act', CAST(event_id % 2 AS STRING)) END AS action,
      concat('h', CAST(user_id % 7 AS STRING)) AS machine, user_id,
      event_id AS p1, CASE event_id % 3 WHEN 0 THEN 467 WHEN 1 THEN 616 ELSE 1 END AS p2, event_id % 25 AS p3,
      concat('q', CAST(event_id % 17 AS STRING)) AS sql_id, 1000 + (event_id % 17) * 10 + event_id % 3 AS sql_plan_hash_value,
      event_id % 6 AS sql_plan_line_id, CASE event_id % 3 WHEN 0 THEN 'TABLE ACCESS' WHEN 1 THEN 'INDEX' ELSE 'HASH JOIN' END AS sql_plan_operation,
      CASE event_id % 3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'RANGE SCAN' END AS sql_plan_options,
      CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 100 END AS sql_exec_id,
      CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(date_trunc('DAY', ts) AS TIMESTAMP_NTZ) END AS sql_exec_start,
      CASE event_id % 40 WHEN 0 THEN CAST(10602832839598511493 AS DECIMAL(20,0)) WHEN 1 THEN CAST(4479854810611774685 AS DECIMAL(20,0))
        ELSE CAST(event_id AS DECIMAL(20,0)) END AS force_matching_signature,
      CASE WHEN event_id % 4 = 0 THEN 'Y' ELSE 'N' END AS in_parse, CASE WHEN event_id % 8 = 0 THEN 'Y' ELSE 'N' END AS in_hard_parse,
      CASE WHEN event_id % 3 = 0 THEN 'N' ELSE 'Y' END AS in_sql_execution,
      CASE WHEN event_id % 29 = 0 THEN -1 WHEN event_id % 31 = 0 THEN NULL ELSE event_id % 40 END AS current_obj,
      event_id % 1000 AS seq_no, CAST(round(value * 100) AS BIGINT) AS units,
      row_number() OVER (PARTITION BY sample_time, snap_id, sample_id, user_id ORDER BY event_id) AS rn
    FROM (SELECT *, CAST(extract(YEAR FROM ts) * 8784 + extract(DOY FROM ts) * 24 + extract(HOUR FROM ts) AS BIGINT) AS sample_id,
        CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS sample_time,
        CAST(extract(YEAR FROM ts) * 366 + extract(DOY FROM ts) AS BIGINT) AS snap_id
      FROM {events}) e) b
  WHERE rn = 1) s
"""

VIEWS["wait_history"] = """
SELECT 1 + event_id % 10 AS seq_no, user_id AS sid,
  CASE event_id % 9 WHEN 0 THEN 'SQL*Net message from client' WHEN 1 THEN 'rdbms ipc message' WHEN 2 THEN 'LNS ASYNC idle wait'
    WHEN 3 THEN 'SQL*Net message to client' WHEN 4 THEN 'SQL*Net more data from client' WHEN 5 THEN 'log file sync'
    WHEN 6 THEN 'db file sequential read' WHEN 7 THEN 'latch free' ELSE 'db file scattered read' END AS event,
  CAST(round(value * 100) AS BIGINT) AS wait_time_micro, CAST(round(value * 10) AS BIGINT) AS time_since_last_wait_micro
FROM {events}
"""

VIEWS["users"] = """
SELECT c_custkey AS user_id, concat('u', CAST(c_custkey AS STRING)) AS username, c_mktsegment AS profile,
  CASE c_custkey % 4 WHEN 0 THEN 'LOCKED(TIMED)' WHEN 1 THEN 'EXPIRED' ELSE 'OPEN' END AS account_status,
  CASE WHEN c_custkey % 4 = 0 THEN CAST('2024-01-05 10:30:00' AS TIMESTAMP_NTZ) END AS lock_date,
  CASE WHEN c_custkey % 4 <> 2 THEN CAST('2024-03-01 00:00:00' AS TIMESTAMP_NTZ) END AS expiry_date
FROM {customer} WHERE c_nationkey < 20
"""

VIEWS["profiles"] = """
SELECT DISTINCT c_mktsegment AS profile, 'PASSWORD_LIFE_TIME' AS resource_name, concat('1', CAST(length(c_mktsegment) AS STRING)) AS limit_value FROM {customer}
UNION ALL
SELECT DISTINCT c_mktsegment, 'FAILED_LOGIN_ATTEMPTS', concat('', CAST(length(c_mktsegment) AS STRING)) FROM {customer}
UNION ALL
SELECT DISTINCT c_mktsegment, 'PASSWORD_GRACE_TIME', '7' FROM {customer} WHERE c_mktsegment <> 'MACHINERY'
"""

VIEWS["objects"] = """
SELECT p_partkey AS object_id, concat('OWN', CAST(p_size % 5 AS STRING)) AS owner, concat('OBJ', CAST(p_partkey AS STRING)) AS object_name,
  CASE WHEN p_partkey % 4 = 0 THEN concat('P', CAST(p_size AS STRING)) END AS subobject_name,
  CASE WHEN p_size <= 25 THEN 'INDEX' WHEN p_partkey % 9 <> 0 THEN 'TABLE'
    ELSE CASE p_partkey % 4 WHEN 0 THEN 'PACKAGE BODY' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'SYNONYM' ELSE 'TABLE' END END AS object_type,
  CASE WHEN p_partkey % 9 = 0 THEN 'INVALID' ELSE 'VALID' END AS status
FROM {part} WHERE p_size <> 7
"""

VIEWS["indexes"] = """
SELECT concat('OWN', CAST(p_size % 5 AS STRING)) AS owner, concat('OBJ', CAST(p_partkey AS STRING)) AS index_name,
  'APP' AS table_owner, concat('T', CAST(p_partkey AS STRING)) AS table_name
FROM {part} WHERE p_size <= 25 AND p_size <> 7
"""

VIEWS["statements"] = """
SELECT concat('q', CAST(p_partkey AS STRING)) AS sql_id, concat('select ', p_name, ' from ', p_type) AS sql_text,
  1000 + p_partkey * 10 AS plan_hash_value, p_partkey * 3 AS executions, p_partkey * 61000000 AS elapsed_time,
  p_size * 7000000 AS user_io_wait_time, 1 + p_partkey % 2 AS inst_id, p_size AS parse_calls
FROM {part}
"""

VIEWS["cursor_area"] = """
SELECT concat('q', CAST(p_partkey AS STRING)) AS sql_id, 1000 + p_partkey * 10 AS plan_hash_value, 1 + p_partkey % 2 AS inst_id,
  concat('2024-01-', lpad(CAST(1 + p_size % 28 AS STRING), 2, '0')) AS first_load_time
FROM {part} WHERE p_size > 15
"""

VIEWS["sessions"] = """
SELECT c_custkey AS sid, c_custkey * 7 + 1 AS serial, 1 + c_custkey % 2 AS inst_id, c_custkey * 11 AS audsid,
  CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 10 = 3 THEN 'SYS' ELSE concat('u', CAST(c_custkey % 30 AS STRING)) END AS username,
  CASE WHEN c_custkey % 12 = 0 THEN 'BACKGROUND' ELSE 'USER' END AS type,
  CASE WHEN c_custkey % 8 = 1 THEN 'oracle@h (J002)' ELSE concat('app', CAST(c_custkey % 3 AS STRING)) END AS program,
  CASE WHEN c_acctbal > 4000 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status,
  CASE c_nationkey % 3 WHEN 0 THEN 'Idle' WHEN 1 THEN 'User I/O' ELSE 'Commit' END AS wait_class,
  CAST(concat('2024-01-', lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0'), ' 08:00:00') AS TIMESTAMP_NTZ) AS logon_time
FROM {customer} WHERE c_nationkey < 9
"""

VIEWS["snapshots"] = """
SELECT o_orderkey AS snap_id, 1 AS instance_number, o_orderdate AS end_interval_time FROM {orders}
UNION ALL
SELECT o_orderkey AS snap_id, 2 AS instance_number, o_orderdate AS end_interval_time FROM {orders}
"""

VIEWS["stmt_stat"] = """
SELECT l_orderkey AS snap_id, 1 + l_linenumber % 2 AS instance_number, p_brand AS sql_id, l_suppkey AS plan_hash_value,
  CASE WHEN l_linenumber = 1 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS executions_delta,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS elapsed_time_delta, CAST(round(l_extendedprice * 60) AS BIGINT) AS cpu_time_delta,
  l_partkey AS buffer_gets_delta, l_partkey * 5000 AS disk_reads_delta, CAST(l_quantity AS BIGINT) * l_linenumber AS rows_processed_delta,
  l_linenumber AS parse_calls_delta, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS invalidations_delta,
  l_partkey * 1000000 AS physical_read_bytes_delta, l_partkey * 100 AS physical_read_requests_delta,
  p_size AS optimizer_cost, 1 + l_linenumber % 3 AS loaded_versions
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
"""

VIEWS["metrics"] = """
SELECT CAST(date_trunc('MINUTE', ts) AS TIMESTAMP_NTZ) AS begin_time, event_type AS metric_name,
  CAST(value AS DECIMAL(18,2)) AS value, 2 + event_id % 2 AS group_id
FROM {events}
"""

VIEWS["instances"] = """
SELECT c_custkey AS id, concat('inst', CAST(c_custkey AS STRING)) AS instance_name, concat('DB', CAST(c_custkey AS STRING)) AS database_name,
  c_mktsegment AS host_name, CASE c_nationkey % 5 WHEN 0 THEN 'agent' WHEN 1 THEN 'rac' ELSE 'single' END AS instance_type,
  concat(c_mktsegment, '_db', CAST(c_custkey AS STRING)) AS dblink_name,
  CASE WHEN c_custkey % 23 = 0 THEN CAST('2023-06-01 00:00:00' AS TIMESTAMP_NTZ) END AS del_date,
  CASE c_custkey % 9 WHEN 0 THEN 'None' WHEN 1 THEN NULL ELSE 'Gold' END AS billing_category,
  CASE c_custkey % 7 WHEN 0 THEN 'Standby' WHEN 1 THEN NULL ELSE 'Main' END AS standby_status,
  CASE WHEN c_custkey % 4 = 0 THEN 'Test' ELSE 'Production' END AS status, concat('app', CAST(c_nationkey AS STRING)) AS application
FROM {customer}
"""

VIEWS["param_rows"] = """
SELECT o_custkey AS inst_id, CAST(date_trunc('YEAR', o_orderdate) AS TIMESTAMP_NTZ) AS date_collected, o_orderpriority AS param_name,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderstatus END AS param_value,
  CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN lower(o_orderstatus)
    WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS spparam_value,
  CASE WHEN o_orderkey % 2 = 0 THEN '*' ELSE 'sid1' END AS spparam_sid,
  CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'TRUE' ELSE 'FALSE' END AS param_isdefault,
  CASE WHEN o_orderkey % 4 = 0 THEN 'MODIFIED' ELSE 'FALSE' END AS param_ismodified
FROM {orders}
"""

VIEWS["param_hist"] = """
SELECT inst_id, date_collected, param_name, max(param_value) AS param_value, min(spparam_value) AS spparam_value,
  max(param_isdefault) AS param_isdefault, max(param_ismodified) AS param_ismodified
FROM {param_rows} GROUP BY inst_id, date_collected, param_name
"""

# Numbers kept as text, one row per instance, day and name.
VIEWS["measures"] = """
SELECT o_custkey AS inst_id, CAST(date_trunc('YEAR', o_orderdate) AS TIMESTAMP_NTZ) AS date_collected, o_orderpriority AS name,
  CAST(sum(CAST(floor(o_totalprice) AS BIGINT) * 10000) AS STRING) AS value
FROM {orders} GROUP BY o_custkey, date_trunc('YEAR', o_orderdate), o_orderpriority
"""

VIEWS["thresholds"] = """
SELECT date_collected, target_type, target_name, metric, key_value, warning_threshold, critical_threshold, groups_grid, host_name,
  comparison_operator, occurrence_count, collection_frequency, is_enabled FROM (
SELECT CAST(date_trunc('YEAR', l_shipdate) AS TIMESTAMP_NTZ) AS date_collected, l_returnflag AS target_type, s_name AS target_name, p_brand AS metric,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE l_linestatus END AS key_value,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(CAST(floor(l_quantity / 10) AS BIGINT) AS STRING) END AS warning_threshold,
  CAST(l_linenumber AS STRING) AS critical_threshold,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE concat('G', CAST((l_suppkey + extract(YEAR FROM l_shipdate)) % 4 AS STRING)) END AS groups_grid,
  concat('host', CAST(s_nationkey AS STRING)) AS host_name, CASE WHEN p_size % 2 = 0 THEN '>' ELSE '<' END AS comparison_operator,
  l_linenumber AS occurrence_count, concat(CAST(5 * (1 + p_size % 3) AS STRING), ' Min') AS collection_frequency,
  CASE WHEN l_linenumber = 7 THEN 0 WHEN l_linenumber = 6 THEN NULL ELSE 1 END AS is_enabled,
  row_number() OVER (PARTITION BY date_trunc('YEAR', l_shipdate), s_name, p_brand, CASE WHEN p_size % 5 = 0 THEN NULL ELSE l_linestatus END
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate) AS rn
FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {part} ON p_partkey = l_partkey) x WHERE rn = 1
"""

# The first line of each threshold in the order of the view's window, and what the view shows of it.
_THRESHOLD_LINES = """
SELECT CAST(date_trunc('YEAR', l_shipdate) AS TIMESTAMP_NTZ) AS date_collected, s_name AS target_name, p_brand AS metric,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE l_linestatus END AS key_value,
  struct(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate, p_size, l_suppkey, s_nationkey) AS line
FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {part} ON p_partkey = l_partkey
"""
_THRESHOLD_COLUMNS = """date_collected; line.l_returnflag AS target_type; target_name; metric; key_value
CASE WHEN line.p_size % 4 = 0 THEN NULL ELSE CAST(CAST(floor(line.l_quantity / 10) AS BIGINT) AS STRING) END AS warning_threshold
CAST(line.l_linenumber AS STRING) AS critical_threshold
CASE WHEN line.l_suppkey % 9 = 0 THEN NULL ELSE concat('G', CAST((line.l_suppkey + extract(YEAR FROM line.l_shipdate)) % 4 AS STRING)) END AS groups_grid
concat('host', CAST(line.s_nationkey AS STRING)) AS host_name; CASE WHEN line.p_size % 2 = 0 THEN '>' ELSE '<' END AS comparison_operator
line.l_linenumber AS occurrence_count; concat(CAST(5 * (1 + line.p_size % 3) AS STRING), ' Min') AS collection_frequency
CASE WHEN line.l_linenumber = 7 THEN 0 WHEN line.l_linenumber = 6 THEN NULL ELSE 1 END AS is_enabled"""


def thresholds(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of the view thresholds by an aggregation: unlike the view's window it lets filters on its keys down to the scans, and
    falls away where only distinct keys or their extremes are asked for (the latest date)."""
    first = spark.sql(_THRESHOLD_LINES, **tables).groupBy("date_collected", "target_name", "metric", "key_value").agg(F.min("line").alias("line"))
    return first.selectExpr(*[c for line in _THRESHOLD_COLUMNS.splitlines() for c in line.split("; ")])


# Views that Spark gets in another form, of the same rows.
FRAMES = {"thresholds": thresholds}

VIEWS["targets"] = """
SELECT s_suppkey AS target_guid, s_name AS target_name, CASE WHEN s_suppkey % 3 = 0 THEN 'host' ELSE 'database' END AS target_type,
  concat('host', CAST(s_nationkey AS STRING)) AS host_name FROM {supplier}
"""

VIEWS["target_groups"] = """
SELECT DISTINCT l_suppkey AS member_guid, concat('G', CAST(l_orderkey % 4 AS STRING)) AS group_name,
  CASE WHEN l_linenumber = 1 THEN 'composite' ELSE 'other' END AS group_type FROM {lineitem} WHERE l_linestatus = 'F'
"""

VIEWS["settings"] = """
SELECT l_suppkey AS target_guid, l_partkey AS metric_guid, l_orderkey AS line_id,
  CASE p_size % 4 WHEN 0 THEN 'User-Defined Numeric Metric' WHEN 1 THEN 'Status' WHEN 2 THEN 'Tablespace Used' ELSE 'Error Count' END AS column_label,
  CASE WHEN p_size % 7 = 0 THEN 'alertLog1' ELSE 'load' END AS metric_name, concat('coll', CAST(l_linenumber AS STRING)) AS collection_name,
  CASE WHEN l_linenumber = 3 THEN ' ' ELSE concat(' ', l_linestatus) END AS key_value, CASE WHEN l_linenumber = 4 THEN l_returnflag END AS key_value2,
  l_linenumber AS critical_operator, 9 AS warning_operator,
  CASE WHEN l_linenumber < 3 THEN '  ' ELSE CAST(l_linenumber AS STRING) END AS warning_threshold,
  CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE ' 5 ' END AS critical_threshold, l_linenumber AS occurrence_count
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
"""

VIEWS["collections"] = """
SELECT DISTINCT l_suppkey AS target_guid, l_partkey AS metric_guid, concat('coll', CAST(l_linenumber AS STRING)) AS collection_name,
  l_linenumber % 2 AS is_enabled,
  CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN concat('<Schedule START_TIME="10:00:00"><IntervalSchedule INTERVAL="', CAST(l_linenumber AS STRING), '" TIME_UNIT="Hr"/></Schedule>')
    ELSE concat('<Schedule><IntervalSchedule INTERVAL="', CAST(l_linenumber AS STRING), '"/></Schedule>') END AS schedule_xml
FROM {lineitem} WHERE l_linestatus = 'O'
"""

VIEWS["metric_titles"] = """
SELECT p_partkey AS metric_guid, CASE WHEN p_size % 11 = 0 THEN 'Incident' ELSE concat(p_brand, ' ') END AS metric_label FROM {part} WHERE p_size <> 6
"""

VIEWS["audit"] = """
SELECT ts AS event_time, concat('u', CAST(user_id AS STRING)) AS username, concat('h', CAST(event_id % 7 AS STRING)) AS userhost,
  CASE WHEN event_type <> 'error' THEN 0 WHEN user_id % 4 = 0 THEN 28000 WHEN user_id % 4 = 1 THEN 28001
    WHEN user_id % 4 = 2 THEN 1017 ELSE 1045 END AS returncode,
  user_id * 11 AS sessionid, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS logoff_time
FROM {events}
"""

VIEWS["files"] = """
SELECT o_orderkey AS file_id, concat(CASE WHEN o_orderkey % 50 = 0 THEN '/lfs/f' ELSE '/data/P01/f' END, CAST(o_orderkey AS STRING)) AS file_name,
  o_orderpriority AS tablespace_name, CAST(floor(o_totalprice) AS BIGINT) AS blocks, CASE WHEN o_orderstatus = 'F' THEN 'NO' ELSE 'YES' END AS autoextensible
FROM {orders}
"""

VIEWS["extents"] = """
SELECT l_orderkey AS file_id, l_partkey AS block_id, CAST(l_quantity AS BIGINT) AS blocks FROM {lineitem} WHERE l_quantity > 5
"""

VIEWS["tablespaces"] = """
SELECT DISTINCT o_orderpriority AS tablespace_name, CASE WHEN o_orderpriority LIKE '1%' THEN 16384 ELSE 8192 END AS block_size FROM {orders}
"""

VIEWS["task_windows"] = """
SELECT o_custkey AS inst_id, CAST(date_trunc('YEAR', o_orderdate) AS TIMESTAMP_NTZ) AS date_collected,
  CASE o_orderkey % 8 WHEN 0 THEN 'MONDAY_WINDOW' WHEN 1 THEN 'TUESDAY_WINDOW' WHEN 2 THEN 'WEDNESDAY_WINDOW' WHEN 3 THEN 'THURSDAY_WINDOW'
    WHEN 4 THEN 'FRIDAY_WINDOW' WHEN 5 THEN 'SATURDAY_WINDOW' WHEN 6 THEN 'SUNDAY_WINDOW' ELSE 'NIGHT_WINDOW' END AS window_name,
  max(CASE WHEN o_orderstatus = 'F' THEN 'ENABLED' ELSE 'DISABLED' END) AS optimizer_stats,
  max(CASE WHEN o_orderstatus = 'O' THEN 'ENABLED' ELSE 'DISABLED' END) AS segment_advisor,
  max(CASE WHEN o_orderstatus = 'P' THEN 'ENABLED' ELSE 'DISABLED' END) AS sql_tune_advisor,
  max('DISABLED') AS health_monitor
FROM {orders} GROUP BY o_custkey, date_trunc('YEAR', o_orderdate), o_orderkey % 8
"""

VIEWS["password_hist"] = """
SELECT o_custkey AS inst_id, o_orderpriority AS profile, CAST(date_trunc('YEAR', o_orderdate) AS TIMESTAMP_NTZ) AS date_collected,
  CASE WHEN o_custkey % 5 = 0 THEN 'NULL' ELSE 'VERIFY_FUNCTION' END AS password_verify_function,
  CAST(min(o_orderkey % 7 + 4) AS STRING) AS password_length, CAST(max(o_orderkey % 90) AS STRING) AS password_life_time, count(*) AS count_users
FROM {orders} GROUP BY o_custkey, o_orderpriority, date_trunc('YEAR', o_orderdate)
"""

# Text records of a cluster-resource dump, one per resource and server.
VIEWS["dump"] = """
SELECT sv, kind, unit, concat('NAME=', res_name, chr(10), 'TYPE=ora.', lower(kind), '.type', chr(10), 'ACL=owner:own', CAST(unit % 3 AS STRING), ':rwx,pgrp:grp', CAST(unit % 2 AS STRING), ':r-x', chr(10),
  'ENABLED=1', chr(10), 'ENABLED@SERVERNAME(node1)=', CAST(unit % 2 AS STRING), chr(10), 'ORACLE_HOME=/u01/app/1', CAST(2 + unit % 7 AS STRING), '.1.0/db', chr(10),
  'DATABASE_TYPE=RAC', chr(10), 'ROLE=', CASE WHEN unit % 4 = 0 THEN 'PHYSICAL_STANDBY' ELSE 'PRIMARY' END, chr(10), 'ENDPOINTS=TCP:', CAST(1521 + unit % 5 AS STRING), chr(10),
  'PLUGGABLE_DATABASE=', CASE WHEN unit % 3 = 0 THEN 'pdb1' ELSE '' END, chr(10), 'USR_ORA_VIP=', CASE WHEN kind = 'TECH' THEN concat('10.0.0.', CAST(unit % 250 AS STRING)) ELSE '' END, chr(10),
  'LAST_SERVER=node', CAST(sv AS STRING), chr(10), 'STATE=', CASE WHEN unit % 6 = sv THEN 'OFFLINE' ELSE concat('ONLINE on node', CAST(sv AS STRING)) END, chr(10), 'TARGET=', CASE WHEN unit % 7 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END, chr(10),
  'USR_ORA_OPEN_MODE=', CASE unit % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'read only' ELSE 'mount' END, chr(10),
  'LAST_RESTART=', CASE WHEN unit % 9 = 0 THEN 'NEVER' ELSE concat('01/', lpad(CAST(1 + unit % 28 AS STRING), 2, '0'), '/2024 10:00:00') END, chr(10),
  'STATE_DETAILS=', CASE unit % 5 WHEN 0 THEN 'Open,HOME=/u01/app' WHEN 1 THEN 'Instance Shutdown' WHEN 2 THEN 'Open,Readonly' WHEN 3 THEN 'Mounted (Closed),Open Initiated' ELSE 'Open' END) AS value
FROM (
  SELECT DISTINCT 1 + CAST(o_orderkey % 3 AS BIGINT) AS sv, o_custkey AS unit,
    CASE o_custkey % 5 WHEN 0 THEN 'DB' WHEN 1 THEN 'SERVICE' WHEN 2 THEN 'LISTENER' WHEN 3 THEN 'PDB' ELSE 'TECH' END AS kind,
    concat('ora.', CASE o_custkey % 5 WHEN 0 THEN concat('db', CAST(o_custkey AS STRING), '.db') WHEN 1 THEN concat('db', CAST(o_custkey - 1 AS STRING), '.svc', CAST(o_custkey AS STRING), '.svc')
      WHEN 2 THEN concat('LISTENER', CASE WHEN o_custkey % 2 = 0 THEN '_SCAN' ELSE '' END, CAST(o_custkey AS STRING), '.lsnr') WHEN 3 THEN concat('db', CAST(o_custkey - 3 AS STRING), '.pdb', CAST(o_custkey AS STRING), '.pdb')
      ELSE concat('vol', CAST(o_custkey AS STRING), '.advm') END) AS res_name
  FROM {orders}) d
"""

# Four-line records with comma lists, one target and state per server.
VIEWS["status_lists"] = """
SELECT concat('NAME=ora.r', CAST(c_custkey AS STRING), chr(10), 'TYPE=', c_mktsegment, chr(10), 'TARGET=ONLINE , OFFLINE, ONLINE', chr(10),
  'STATE=ONLINE on n', CAST(c_nationkey AS STRING), ', OFFLINE,', CASE WHEN c_custkey % 2 = 0 THEN 'ONLINE' ELSE 'INTERMEDIATE' END) AS value
FROM {customer}
"""

_REF = re.compile(r"\{(\w+)\}")


def references(name: str) -> list[str]:
    """Tables and views a view reads, in order of first use."""
    return list(dict.fromkeys(_REF.findall(VIEWS[name])))


class Inputs:
    """Test tables and derived views of one scale-factor folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._seen:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                tables = {r: getattr(self, r) for r in references(name)}
                df = FRAMES[name](self.spark, tables) if name in FRAMES else self.spark.sql(VIEWS[name], **tables)
            self._seen[name] = df
        return self._seen[name]


def _needed(sql: str) -> list[str]:
    """Views mentioned in sql, dependencies first."""
    out: list[str] = []

    def add(view: str) -> None:
        for r in references(view):
            if r in VIEWS:
                add(r)
        if view not in out:
            out.append(view)

    for view in VIEWS:
        if re.search(rf"\b{view}\b", sql):
            add(view)
    return out


def expected(sql: str) -> str:
    """Complete the expected-result SQL with the views it mentions."""
    parts = [f"{v} AS ({_REF.sub(lambda m: m[1], VIEWS[v])})" for v in _needed(sql)]
    text = f"WITH {', '.join(parts)} SELECT * FROM ({sql}) result" if parts else sql
    return text.replace("TIMESTAMP_NTZ", "TIMESTAMP")
