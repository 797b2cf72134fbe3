"""Audit, live-session, storage and memory queries."""

from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators.topn import top_k
from ..plans import audit_reports as R, storage_reports as S
from ..sources import scripts
from .registry import query, rounded

MESSAGE = """CASE returncode WHEN 28000 THEN 'Account is locked' WHEN 28001 THEN 'Password is expired' WHEN 1017 THEN 'Invalid username or password'
  WHEN 1045 THEN 'User lacks CREATE SESSION privilege' END"""
FAILED = """SELECT CAST(date_trunc('day', event_time) AS TIMESTAMP) AS day, username, userhost, returncode, count(*) AS cnt FROM audit
  WHERE returncode <> 0 AND event_time >= TIMESTAMP '2024-01-02 00:00:00' AND event_time < TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1, 2, 3, 4 HAVING count(*) > {n}"""
FEW = 1
ROLLED = f"""SELECT day, username, returncode, {MESSAGE} AS message, CAST(sum(cnt) AS BIGINT) AS attempts, string_agg(userhost, ',' ORDER BY userhost) AS hosts FROM ({FAILED.format(n=FEW)}) f GROUP BY 1, 2, 3"""


def _limit(name):
    return f"(SELECT resource_name || '  - ' || limit_value FROM users u JOIN profiles p ON p.profile = u.profile AND p.resource_name = '{name}' WHERE u.username = r.username)"


STATE = "(SELECT {x} FROM users u WHERE u.username = r.username)"
DATE = "coalesce(strftime({c}, '%d.%m.%Y %H:%M'), '')"


def _state(when):
    return STATE.format(x="account_status || '  - ' || " + when)


@query("a21_failed_login_rollup", f"SELECT day, username, returncode, attempts, hosts FROM ({ROLLED}) r")
def _(t):
    return R.failed_logins(t.audit, t.users, t.profiles, "2024-01-02 00:00:00", "2024-01-30 00:00:00", more_than=FEW).select("day", "username", "returncode", "attempts", "hosts")


@query("r24_failed_logins", f"""SELECT r.*, CASE returncode WHEN 28001 THEN {_state(DATE.format(c='expiry_date'))} WHEN 28000 THEN {_state(DATE.format(c='lock_date'))}
    WHEN 1045 THEN {_state("CASE WHEN account_status LIKE '%LOCK%' THEN " + DATE.format(c='lock_date') + " WHEN account_status LIKE '%EXPIR%' THEN " + DATE.format(c='expiry_date') + " ELSE '' END")}
    WHEN 1017 THEN coalesce({STATE.format(x='account_status')}, '<User does not exist>') END AS account,
    CASE returncode WHEN 28001 THEN {_limit('PASSWORD_LIFE_TIME')} WHEN 28000 THEN {_limit('FAILED_LOGIN_ATTEMPTS')} END AS profile_setting FROM ({ROLLED}) r""")
def _(t):
    return R.failed_logins(t.audit, t.users, t.profiles, "2024-01-02 00:00:00", "2024-01-30 00:00:00", more_than=FEW)


HOURLY = f"SELECT CAST(date_trunc('hour', event_time) AS TIMESTAMP) AS at, username, userhost, returncode, count(*) AS attempts, {MESSAGE} AS message FROM audit WHERE returncode <> 0 GROUP BY 1, 2, 3, 4"


@query("a22_failed_logins_hourly", f"SELECT h.*, u.lock_date, u.expiry_date FROM ({HOURLY}) h JOIN users u ON u.username = h.username")
def _(t):
    return R.failed_logins_hourly(t.audit, t.users)


@query("r25_failed_logins_per_day", HOURLY.replace("'hour'", "'day'"))
def _(t):
    return R.failed_logins_per(t.audit, "day")


@query("r25_lock_reason", f"""SELECT strftime(event_time, '%H:%M:%S') AS clock, username, userhost, returncode, {MESSAGE} AS message FROM audit
  WHERE username IN ('u7', 'u8', 'u9') AND event_time BETWEEN TIMESTAMP '2024-01-22 12:00:00' AND TIMESTAMP '2024-01-25 12:00:00'""")
def _(t):
    return R.lock_reason(t.audit, ["u7", "u8", "u9"], "2024-01-22 12:00:00", "2024-01-25 12:00:00")


@query("r25_failed_by_host", "SELECT userhost, username, count(*) AS cnt FROM audit WHERE returncode <> 0 AND event_time > TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2")
def _(t):
    return R.failed_by_host(t.audit, "2024-01-20 00:00:00")


@query("j11_dead_sessions", """SELECT event_time, username, sessionid FROM audit a WHERE logoff_time IS NULL AND event_time > TIMESTAMP '2024-01-29 00:00:00' AND returncode = 0
  AND username NOT IN ('u3', 'u4') AND NOT EXISTS (SELECT 1 FROM sessions s WHERE s.audsid = a.sessionid)""")
def _(t):
    return R.dead_sessions(t.audit, t.sessions, "2024-01-29 00:00:00", ["u3", "u4"]).select("event_time", "username", "sessionid")


@query("a23_hourly_histogram", "SELECT strftime(event_time, '%Y.%m.%d') AS day, strftime(event_time, '%H') AS hour, count(*) AS total FROM audit WHERE returncode = 0 GROUP BY 1, 2")
def _(t):
    return R.hourly_histogram(t.audit.where("returncode = 0"), "event_time")


USER = "coalesce(username, '_' || type)"
ACTIVE = "count(*) FILTER (WHERE status = 'ACTIVE' AND wait_class <> 'Idle')"
RANK = "CASE user_name WHEN '_BACKGROUND' THEN 1 WHEN 'SYS' THEN 2 WHEN 'DBSNMP' THEN 3 WHEN 'SYSRAC' THEN 4 WHEN '_USER' THEN 5 ELSE 6 END"


@query("a34_sessions_by_user", f"SELECT * FROM (SELECT {USER} AS user_name, count(*) AS sessions, {ACTIVE} AS active FROM sessions GROUP BY 1) u ORDER BY {RANK}, sessions DESC NULLS LAST, user_name LIMIT 14")
def _(t):
    return R.sessions_by_user(t.sessions)


@query("r30_sessions_by_user_and_node", f"SELECT * FROM (SELECT inst_id, {USER} AS user_name, count(*) AS sessions, {ACTIVE} AS active FROM sessions GROUP BY 1, 2 HAVING count(*) > 3) u ORDER BY inst_id, {RANK}, sessions DESC NULLS LAST, user_name LIMIT 29")
def _(t):
    return R.sessions_by_user(t.sessions, 29, per_node=True, more_than=3)


@query("t04_category_order", f"SELECT user_name, {RANK} AS position FROM (SELECT DISTINCT {USER} AS user_name FROM sessions) u")
def _(t):
    return t.sessions.select(R.user_name().alias("user_name")).distinct().withColumn("position", R.user_rank("user_name"))


PERSON = "username IS NOT NULL AND program NOT LIKE 'oracle%(J%'"
SUMMARY = f"SELECT count(*) FILTER (WHERE {PERSON}) AS total_sessions, {ACTIVE} AS active_sessions, min(logon_time) FILTER (WHERE {PERSON}) AS connected_since, (SELECT max(o_orderdate) FROM orders) AS last_switch FROM sessions"


@query("a35_instance_summary", SUMMARY)
def _(t):
    return R.instance_summary(t.sessions, t.orders.select(F.col("o_orderdate").alias("switch_time")))


@query("r30_instance_check", f"""SELECT 'summary' AS section, NULL AS user_name, total_sessions AS sessions, active_sessions AS active, connected_since, last_switch FROM ({SUMMARY}) s
  UNION ALL SELECT 'user', user_name, sessions, active, NULL, NULL FROM (SELECT {USER} AS user_name, count(*) AS sessions, {ACTIVE} AS active FROM sessions GROUP BY 1) u""")
def _(t):
    return R.instance_check(t.sessions, t.orders.select(F.col("o_orderdate").alias("switch_time")))


def _checks(t):
    distinct_counts = t.region.agg(F.count(F.lit(1)).alias("i")).unionByName(t.nation.where("n_regionkey < 1").agg(F.count(F.lit(1)).alias("i"))).distinct()
    return [R.check(t.region, "regions", 5), R.check(t.nation.where("n_name LIKE 'NATION_1%'"), "ones", 11),
            R.check(t.customer.where("c_custkey < 0"), "none", 0),
            distinct_counts.agg(F.sum("i").alias("found")).select(F.lit("sum of distinct counts").alias("check_name"), "found", F.lit(5).cast("bigint").alias("expected"))]


CHECKS = """SELECT (SELECT count(*) FROM region) = 5 AS ok UNION ALL SELECT (SELECT count(*) FROM nation WHERE n_name LIKE 'NATION_1%') = 11 UNION ALL SELECT (SELECT count(*) FROM customer WHERE c_custkey < 0) = 0
  UNION ALL SELECT (SELECT sum(i) FROM (SELECT count(*) AS i FROM region UNION SELECT count(*) FROM nation WHERE n_regionkey < 1) x) = 5"""
VERDICT = f"SELECT count(*) FILTER (WHERE ok) AS passed, count(*) AS checks, CASE WHEN count(*) FILTER (WHERE ok) = count(*) THEN 'true' ELSE 'false' END AS compliant FROM ({CHECKS}) c"


@query("a36_all_checks", VERDICT)
def _(t):
    return R.all_checks(*_checks(t))


@query("r31_audit_policy_compliance", """SELECT count(*) FILTER (WHERE ok) AS passed, count(*) AS checks, CASE WHEN count(*) FILTER (WHERE ok) = count(*) THEN 'true' ELSE 'false' END AS compliant FROM (
  SELECT (SELECT count(*) FROM audit WHERE returncode NOT IN (0, 28000, 28001, 1017, 1045)) = 0 AS ok UNION ALL SELECT (SELECT count(*) FROM profiles WHERE resource_name = 'PASSWORD_GRACE_TIME') = 5) c""")
def _(t):
    return R.all_checks(R.check(t.audit.where("returncode NOT IN (0, 28000, 28001, 1017, 1045)"), "unknown codes", 0),
                        R.check(t.profiles.where("resource_name = 'PASSWORD_GRACE_TIME'"), "grace times", 5))

# ---- storage and memory ------------------------------------------------------------------

MIN_MB = "CAST(ceil(coalesce(hwm, 1) * block_size / 1048576) AS BIGINT)"
CUR_MB = "CAST(ceil(blocks * block_size / 1048576) AS BIGINT)"
SHRINK = f"""SELECT file_id, file_name, min_mb, current_mb, current_mb - min_mb AS saving_mb, autoextensible FROM (
  SELECT f.file_id, file_name, autoextensible, {MIN_MB} AS min_mb, {CUR_MB} AS current_mb FROM files f JOIN tablespaces b ON b.tablespace_name = f.tablespace_name
  LEFT JOIN (SELECT file_id, max(block_id + blocks - 1) AS hwm FROM extents GROUP BY 1) h ON h.file_id = f.file_id WHERE file_name NOT LIKE '/lfs%') s WHERE current_mb - min_mb > 200"""
RESIZE = "'alter database datafile ''' || file_name || ''' resize ' || (min_mb + 1) || 'M;'"


@query("p15_shrink_sizes", f"SELECT file_id, min_mb, current_mb, saving_mb FROM ({SHRINK}) s")
def _(t):
    return S.shrink_candidates(t.files, t.extents, t.tablespaces, exclude="/lfs%").select("file_id", "min_mb", "current_mb", "saving_mb")


@query("r28_shrink_candidates", f"""SELECT file_id, file_name, min_mb, current_mb, saving_mb, {RESIZE} AS script,
    CASE WHEN autoextensible = 'NO' THEN 'alter database datafile ''' || file_name || ''' autoextend on next 10M maxsize ' || current_mb || 'M;' END AS script2 FROM ({SHRINK}) s""")
def _(t):
    return S.shrink_candidates(t.files, t.extents, t.tablespaces, exclude="/lfs%")


@query("p14_rename_commands", "SELECT 'alter database rename file ''' || file_name || ''' to ''' || replace(file_name, 'P01', 'Q01') || ''';' AS line FROM files")
def _(t):
    return S.rename_commands(t.files, "P01", "Q01")


@query("p14_recompile_commands", """SELECT CASE object_type WHEN 'PACKAGE BODY'
    THEN 'alter package "' || owner || '"."' || object_name || '" compile body' ELSE 'alter ' || lower(object_type) || ' "' || owner || '"."' || object_name || '" compile' END AS line
  FROM objects WHERE status = 'INVALID' AND object_type NOT IN ('INDEX', 'TABLE')""")
def _(t):
    return S.recompile_commands(t.objects)


@query("p14_delete_target_commands", """SELECT 'emcli delete_target -name="' || target_name || '" -type="host"' AS line FROM targets WHERE target_name LIKE '%3%' AND target_type = 'host'""")
def _(t):
    return S.delete_target_commands(t.targets, "%3%", "host")


@query("s13_script_sink", f"SELECT {RESIZE} AS line FROM ({SHRINK}) s")
def _(t):
    from ..session import scratch_dir
    path = scratch_dir(t.spark, "script")
    scripts.write_script(S.shrink_candidates(t.files, t.extents, t.tablespaces, exclude="/lfs%").select(F.col("script").alias("line")), path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


MEMORY = {"1-URGENT": "sga_mb", "2-HIGH": "pga_mb", "3-MEDIUM": "pga_target_mb"}
MEM_COLS = ", ".join(f"coalesce(max({rounded('CAST(value AS BIGINT)', '1048576')}) FILTER (WHERE name = '{n}'), 0) AS {a}" for n, a in MEMORY.items())
MEM_LINES = f"""SELECT i.instance_name, m.* EXCLUDE (inst_id) FROM (SELECT id, instance_name FROM instances WHERE instance_type <> 'agent') i
  LEFT JOIN (SELECT inst_id, {MEM_COLS} FROM measures WHERE date_collected = (SELECT max(date_collected) FROM measures) GROUP BY 1) m ON m.inst_id = i.id"""
MEM_SUMS = ", ".join(f"CAST(sum({a}) AS BIGINT) AS {a}" for a in MEMORY.values())


@query("a40_memory_report", f"""SELECT CASE WHEN grouping(instance_name) = 1 THEN 'Total' ELSE instance_name END AS instance, {MEM_SUMS},
    CASE WHEN grouping(instance_name) = 0 AND sum(sga_mb) IS NULL THEN 'Database is down' END AS note FROM ({MEM_LINES}) l GROUP BY ROLLUP (instance_name)""")
def _(t):
    from ..operators.snapshots import latest_snapshot
    return S.memory_report(latest_snapshot(t.measures), t.instances.where("instance_type <> 'agent'"), MEMORY)


@query("a41_large_pages", """SELECT tablespace_name, CAST(coalesce(sum(CASE WHEN blocks // 2048 > 0 THEN blocks // 2048 + 1 END), 0) AS BIGINT) AS pages, count(*) FILTER (WHERE blocks // 2048 > 0) AS segments FROM files GROUP BY 1""")
def _(t):
    return S.large_pages(t.files, "blocks", 2048, ["tablespace_name"])


@query("a43_repository_figures", f"""SELECT count(DISTINCT CAST(snap_id AS VARCHAR) || CAST(instance_number AS VARCHAR)) AS snapshot_count, strftime(min(end_interval_time), '%Y-%m-%d') AS oldest_entry,
    (SELECT {rounded('sum(blocks)', '1048576')} FROM files) AS size_mb FROM snapshots""")
def _(t):
    return S.repo_usage(t.snapshots, t.files, "blocks", "end_interval_time")


@query("t06_value_or_zero", "SELECT coalesce(max(blocks), 0) AS value FROM files WHERE tablespace_name = 'no such'")
def _(t):
    return S.value_or_zero(t.files.where("tablespace_name = 'no such'"), "blocks")


@query("t06_largest_value", "SELECT coalesce(max(blocks), 0) AS value FROM files")
def _(t):
    return S.value_or_zero(t.files, "blocks")


@query("p13_top_users", "SELECT username, count(*) AS cnt FROM audit GROUP BY 1 ORDER BY cnt DESC, username LIMIT 15")
def _(t):
    return top_k(A.count_by(t.audit, ["username"]), [F.col("cnt").desc(), F.col("username")], 15)
