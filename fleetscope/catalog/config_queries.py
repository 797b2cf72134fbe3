"""Fleet registry, collection and configuration-drift queries."""

from pyspark.sql import functions as F

from ..operators import activity as A, filters as P, joins as J, snapshots as N
from ..operators.aggregates import agg_list
from ..plans import config_reports as C
from ..sources import fleet
from .registry import query, rounded

LIVE = "instance_type IN ('single', 'rac') AND del_date IS NULL"
BILLED = LIVE + " AND billing_category IS DISTINCT FROM 'None'"
PRIMARY = BILLED + " AND standby_status IS DISTINCT FROM 'Standby'"
ASKED = PRIMARY + " AND (instance_type = 'single' OR instance_name LIKE '%1')"
DAY = "1998-01-01 00:00:00"
DAY_SQL = f"TIMESTAMP '{DAY}'"


def lst(c, cond=""):
    return f"string_agg({c}, ',' ORDER BY {c}) {cond}"


@query("s03_live_instances", f"SELECT id, instance_name FROM instances WHERE {PRIMARY} AND (instance_type = 'single' OR instance_name LIKE '%1')")
def _(t):
    return N.live_instances(t.instances, first_node=True, billed=True, primary=True).select("id", "instance_name")


@query("s04_pending_sources", f"SELECT id, instance_name FROM instances i WHERE {LIVE} AND NOT EXISTS (SELECT 1 FROM param_hist h WHERE h.inst_id = i.id AND h.date_collected = {DAY_SQL})")
def _(t):
    return N.pending_sources(N.live_instances(t.instances), t.param_hist, DAY).select("id", "instance_name")


@query("s02_collect_fleet", f"SELECT c_custkey, c_name, CAST(c_nationkey AS INT) AS id, {DAY_SQL} AS date_collected FROM customer WHERE c_nationkey <> 24")
def _(t):
    """Sources landed as files, one folder per nation; nation 24 is not registered."""
    from ..session import scratch_dir
    path = scratch_dir(t.spark, "landing")
    t.customer.select("c_custkey", "c_name", F.col("c_nationkey").alias("id")).write.partitionBy("id").parquet(path)
    return fleet.collect_landing(t.spark, path, t.nation.where("n_nationkey <> 24").select(F.col("n_nationkey").alias("id")), DAY).withColumn("id", F.col("id").cast("int"))


def _collected(t):
    """Parameters of DAY from every instance that is collected; instances without any are not reachable. Some are collected twice."""
    from ..session import scratch_dir
    path, landing, groups = scratch_dir(t.spark, "fleet"), scratch_dir(t.spark, "instances"), 512
    day = t.param_hist.where(F.col("date_collected") == F.lit(DAY).cast("timestamp_ntz"))
    day = day.select(F.col("inst_id").alias("id"), "param_name", "param_value", fleet.slot_of("inst_id", groups).alias(fleet.SLOT))
    day.repartition(fleet.SLOT).write.partitionBy(fleet.SLOT).parquet(landing)
    registry = N.live_instances(t.instances, first_node=True, billed=True, primary=True).select("id", fleet.slot_of("id", groups).alias(fleet.SLOT))
    connect = fleet.grouped_rows(landing, ["param_name", "param_value"])
    schema = "param_name string, param_value string"
    errors = fleet.collect_at_once(registry, connect, schema, DAY, path, "parameters", group=fleet.SLOT)
    fleet.collect_at_once(registry.where("id % 3 = 0"), connect, schema, DAY, path, "parameters", group=fleet.SLOT)
    return t.spark.read.parquet(path), errors


@query("s02_collect_each_source", f"""SELECT param_name, param_value, CAST(inst_id AS INT) AS inst_id, date_collected FROM param_hist
  WHERE date_collected = {DAY_SQL} AND inst_id IN (SELECT id FROM instances WHERE {ASKED})""")
def _(t):
    return _collected(t)[0].select("param_name", "param_value", F.col("inst_id").cast("int").alias("inst_id"), F.col("date_collected").cast("timestamp_ntz").alias("date_collected"))


@query("s07_collection_errors", f"""SELECT CAST(id AS BIGINT) AS inst_id, 'parameters' AS collector, {DAY_SQL} AS date_collected, 'source ' || id || ' has nothing to read' AS error
  FROM instances i WHERE {ASKED} AND NOT EXISTS (SELECT 1 FROM param_hist h WHERE h.inst_id = i.id AND h.date_collected = {DAY_SQL})""")
def _(t):
    return _collected(t)[1]


@query("s05_idempotent_snapshot_write", "SELECT inst_id, date_collected, param_name, param_value FROM param_hist")
def _(t):
    from ..session import scratch_dir
    path = scratch_dir(t.spark, "snapshot")
    rows = t.param_hist.select("inst_id", "date_collected", "param_name", "param_value")
    fleet.write_snapshot(rows, path)
    fleet.write_snapshot(rows.where((F.col("date_collected") == F.lit(DAY).cast("timestamp_ntz")) & (F.col("inst_id") % 2 == 0)), path)  # some sources collected again
    return t.spark.read.parquet(path).select("inst_id", F.col("date_collected").cast("timestamp_ntz").alias("date_collected"), "param_name", "param_value")


@query("s06_purge_rows", f"SELECT inst_id, date_collected, param_name FROM param_hist WHERE NOT coalesce(param_isdefault IS NOT NULL AND date_collected = {DAY_SQL}, false)")
def _(t):
    from ..session import scratch_dir
    path, kept = scratch_dir(t.spark, "history"), scratch_dir(t.spark, "history")
    fleet.write_snapshot(t.param_hist.select("inst_id", "date_collected", "param_name", "param_isdefault"), path, ("date_collected",))
    stale = F.col("param_isdefault").isNotNull() & (F.col("date_collected").cast("timestamp_ntz") == F.lit(DAY).cast("timestamp_ntz"))
    fleet.purge_stored(t.spark, path, kept, stale, ("date_collected",))
    return t.spark.read.parquet(kept).select("inst_id", F.col("date_collected").cast("timestamp_ntz").alias("date_collected"), "param_name")


@query("s08_saved_extract", "SELECT sample_id, session_id, event FROM samples WHERE sql_id = 'q3'")
def _(t):
    from ..session import scratch_dir
    from ..sources.samples import read_samples, save_extract
    path = scratch_dir(t.spark, "extract")
    save_extract(t.samples.select("sample_id", "session_id", "event", "sql_id"), "sql_id = 'q3'", path)
    return read_samples(t.spark, path).select("sample_id", "session_id", "event")


@query("j08_collection_status", f"""SELECT i.id, i.instance_name, coalesce(h.param_value, 'Not collected') AS status_text FROM instances i
  LEFT JOIN (SELECT * FROM param_hist WHERE param_name = '2-HIGH' AND date_collected = {DAY_SQL}) h ON h.inst_id = i.id WHERE {LIVE}""")
def _(t):
    return N.collection_status(N.live_instances(t.instances), t.param_hist, "2-HIGH", DAY).select("id", "instance_name", "status_text")


@query("j08_collection_status_inner", f"""SELECT i.id, coalesce(h.param_value, 'Not collected') AS status_text FROM instances i
  JOIN param_hist h ON h.inst_id = i.id WHERE param_name = '2-HIGH' AND date_collected = {DAY_SQL} AND {LIVE}""")
def _(t):
    return N.collection_status(N.live_instances(t.instances), t.param_hist, "2-HIGH", DAY, inner=True).select("id", "status_text")


LATEST_OF = "(SELECT max(date_collected) FROM param_hist WHERE param_name = '5-LOW')"


@query("j09_parameter_report", f"""SELECT i.id, h.param_name, h.param_value, h.date_collected FROM instances i
  LEFT JOIN (SELECT * FROM param_hist WHERE param_name = '5-LOW' AND date_collected = {LATEST_OF}) h ON h.inst_id = i.id""")
def _(t):
    return N.param_report(t.instances, t.param_hist, "5-LOW").select("id", "param_name", "param_value", "date_collected")


@query("j09_parameter_report_strict", f"""SELECT i.id, h.param_name, h.param_value, h.date_collected FROM instances i LEFT JOIN param_hist h ON h.inst_id = i.id AND h.param_name = '5-LOW'
  WHERE h.date_collected IS NULL OR h.date_collected = {LATEST_OF}""")
def _(t):
    return N.param_report(t.instances, t.param_hist, "5-LOW", strict_where=True).select("id", "param_name", "param_value", "date_collected")


@query("j10_not_collected", f"SELECT id FROM instances i WHERE {PRIMARY} AND NOT EXISTS (SELECT 1 FROM password_hist h WHERE h.inst_id = i.id AND h.date_collected = {DAY_SQL})")
def _(t):
    return N.missing(N.live_instances(t.instances, billed=True, primary=True), t.password_hist, DAY).select("id")


@query("j13_semi_join", "SELECT inst_id, param_name, param_value FROM param_hist WHERE date_collected IN (SELECT DISTINCT date_collected FROM param_hist ORDER BY 1 DESC LIMIT 2)")
def _(t):
    return J.semi(t.param_hist, N.last_dates(t.param_hist, 2), "date_collected").select("inst_id", "param_name", "param_value")


@query("j20_scalar_lookup", "SELECT a.event_time, a.username, a.returncode, (SELECT account_status FROM users u WHERE u.username = a.username) AS account_status FROM audit a WHERE a.returncode <> 0")
def _(t):
    return J.scalar_lookup(t.audit.where("returncode <> 0"), t.users, "username", "account_status", "account_status") \
        .select("event_time", "username", "returncode", "account_status")


@query("j21_latest_per_key", "SELECT inst_id, profile, date_collected FROM password_hist p WHERE date_collected = (SELECT max(date_collected) FROM password_hist x WHERE x.inst_id = p.inst_id)")
def _(t):
    return N.latest_per_key(t.password_hist, ["inst_id"]).select("inst_id", "profile", "date_collected")


@query("j22_latest_collection", "SELECT inst_id, param_name, param_value FROM param_hist WHERE date_collected = (SELECT max(date_collected) FROM param_hist WHERE param_name = '1-URGENT')")
def _(t):
    return N.latest_snapshot(t.param_hist, "param_name = '1-URGENT'").select("inst_id", "param_name", "param_value")


@query("j23_latest_and_previous", "SELECT max(date_collected) AS latest, max(date_collected) FILTER (WHERE date_collected < (SELECT max(date_collected) FROM thresholds)) AS previous FROM thresholds")
def _(t):
    return N.snapshot_dates(t.thresholds)


@query("t03_last_dates", "SELECT DISTINCT date_collected FROM param_hist ORDER BY date_collected DESC NULLS LAST LIMIT 5")
def _(t):
    return N.last_dates(t.param_hist, 5)


RUNNING = "SELECT DISTINCT o_custkey AS inst_id, o_orderpriority AS name, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS value FROM orders WHERE o_orderstatus <> 'P'"
STORED = "SELECT DISTINCT o_custkey AS inst_id, o_orderpriority AS name, o_orderstatus AS value FROM orders WHERE o_orderstatus <> 'F'"


def _match_sql(strict):
    single = " AND r.value IS NOT NULL" if strict else ""
    return f"""SELECT coalesce(r.inst_id, s.inst_id) AS inst_id, coalesce(r.name, s.name) AS name, r.value AS running_value, s.value AS stored_value
      FROM ({RUNNING}) r FULL JOIN ({STORED}) s ON r.inst_id = s.inst_id AND r.name = s.name
        AND ((r.name IN ('1-URGENT', '5-LOW') AND r.value = s.value) OR (r.name NOT IN ('1-URGENT', '5-LOW'){single}))"""


def _match(t, strict):
    side = lambda sql: t.spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=t.orders)
    return J.match_running_stored(side(RUNNING), side(STORED), ["1-URGENT", "5-LOW"], ("inst_id",), strict)


@query("j25_running_and_stored", _match_sql(False))
def _(t):
    return _match(t, False)


@query("j25_running_and_stored_strict", _match_sql(True))
def _(t):
    return _match(t, True)


@query("j26_one_row_attached", "SELECT id, d.latest, d.previous FROM instances, (SELECT max(date_collected) AS latest, max(date_collected) FILTER (WHERE date_collected < (SELECT max(date_collected) FROM thresholds)) AS previous FROM thresholds) d")
def _(t):
    return J.with_one_row(t.instances, N.snapshot_dates(t.thresholds)).select("id", "latest", "previous")


NAMES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}
LATEST_MEASURES = "(SELECT * FROM measures WHERE date_collected = (SELECT max(date_collected) FROM measures))"
LIVE_NAMES = "(SELECT id AS inst_id, host_name, lower(database_name) AS database FROM instances WHERE del_date IS NULL)"


def _wide(names):
    return ", ".join(f"max(value) FILTER (WHERE name = '{n}') AS {a}" for n, a in names.items())


@query("j06_parameters_as_columns", f"SELECT inst_id, {_wide(NAMES)} FROM {LATEST_MEASURES} m WHERE name IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') GROUP BY inst_id")
def _(t):
    return N.eav_wide(N.latest_snapshot(t.measures), NAMES, ["inst_id"], "name", "value")


@query("j07_required_and_optional", f"""SELECT a.inst_id, a.value AS urgent, b.value AS high, c.value AS medium, d.value AS low FROM {LATEST_MEASURES} a
  JOIN {LATEST_MEASURES} b ON b.inst_id = a.inst_id AND b.name = '2-HIGH' LEFT JOIN {LATEST_MEASURES} c ON c.inst_id = a.inst_id AND c.name = '3-MEDIUM'
  LEFT JOIN {LATEST_MEASURES} d ON d.inst_id = a.inst_id AND d.name = '5-LOW' WHERE a.name = '1-URGENT'""")
def _(t):
    return N.eav_wide(N.latest_snapshot(t.measures), NAMES, ["inst_id"], "name", "value", required=("1-URGENT", "2-HIGH"))


@query("r17_repository_usage", f"""SELECT m.inst_id, host_name, database, urgent, high, medium, CAST(low AS DOUBLE) / 24 / 60 AS low
  FROM (SELECT inst_id, {_wide(NAMES)} FROM {LATEST_MEASURES} x WHERE name IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') GROUP BY inst_id) m JOIN {LIVE_NAMES} i ON i.inst_id = m.inst_id""")
def _(t):
    return C.repository_usage(t.measures, t.instances, NAMES, minutes="low")


PAIR = "(SELECT inst_id, max(value) FILTER (WHERE name = '1-URGENT') AS a, max(value) FILTER (WHERE name = '2-HIGH') AS b FROM " + LATEST_MEASURES + " x WHERE name IN ('1-URGENT', '2-HIGH') GROUP BY inst_id)"


@query("r17_limit_usage", f"""SELECT m.inst_id, host_name, database, a AS limit_value, b AS used_value, {rounded('CAST(b AS BIGINT) * 100', 'CAST(a AS BIGINT)')} AS usage_pct
  FROM {PAIR} m JOIN {LIVE_NAMES} i ON i.inst_id = m.inst_id""")
def _(t):
    return C.limit_usage(t.measures, t.instances, "1-URGENT", "2-HIGH")


@query("r17_value_ratio", f"""SELECT m.inst_id, host_name, database, a AS num_value, b AS den_value, CAST(a AS DOUBLE) / nullif(CAST(b AS DOUBLE), 0) AS ratio
  FROM {PAIR} m JOIN {LIVE_NAMES} i ON i.inst_id = m.inst_id""")
def _(t):
    return C.value_ratio(t.measures, t.instances, "1-URGENT", "2-HIGH")


@query("p16_utilisation", f"SELECT inst_id, {rounded('CAST(b AS BIGINT) * 100', 'CAST(a AS BIGINT)')} AS pct FROM {PAIR} m")
def _(t):
    from ..functions.numbers import to_number, utilisation
    wide = N.eav_wide(N.latest_snapshot(t.measures), {"1-URGENT": "a", "2-HIGH": "b"}, ["inst_id"], "name", "value")
    return wide.select("inst_id", utilisation(to_number("b"), to_number("a")).alias("pct"))


@query("r18_memory_usage", f"""SELECT m.inst_id, host_name, database, {rounded('CAST(urgent AS BIGINT)', '1073741824', 1)} AS target_gb, {rounded('CAST(high AS BIGINT)', '1073741824', 1)} AS allocated_gb,
    {rounded('CAST(medium AS BIGINT)', '1073741824', 1)} AS peak_gb, {rounded('CAST(high AS BIGINT)', 'CAST(urgent AS BIGINT)', 1)} AS usage_ratio, CAST(low AS BIGINT) AS process_count
  FROM (SELECT inst_id, {_wide(NAMES)} FROM {LATEST_MEASURES} x GROUP BY inst_id) m JOIN {LIVE_NAMES} i ON i.inst_id = m.inst_id
  WHERE urgent IS NOT NULL AND high IS NOT NULL AND medium IS NOT NULL""")
def _(t):
    return C.memory_usage(t.measures, t.instances, "1-URGENT", "2-HIGH", "3-MEDIUM", {"5-LOW": "process_count"})


LISTS = f"SELECT date_collected, inst_id, param_name, {lst('param_value')} AS param_value, {lst('spparam_value')} AS spparam_value FROM param_rows WHERE param_isdefault IS NOT NULL {{cond}} GROUP BY 1, 2, 3"


@query("a25_sorted_lists", LISTS.format(cond=""))
def _(t):
    return C.param_lists(t.param_rows, ["date_collected", "inst_id", "param_name"])


CHANGES = """SELECT * FROM (SELECT *, lag(param_value) OVER (PARTITION BY inst_id, param_name ORDER BY date_collected DESC NULLS FIRST) AS changed_to,
    lag(date_collected) OVER (PARTITION BY inst_id, param_name ORDER BY date_collected DESC NULLS FIRST) AS changed_at FROM ({source}) l) c
  WHERE {ne} AND changed_at IS NOT NULL"""
NOCASE = "lower(coalesce(param_value, '1')) <> lower(coalesce(changed_to, '1'))"


@query("w03_change_history", CHANGES.format(source="SELECT inst_id, date_collected, param_name, param_value FROM param_hist", ne=NOCASE))
def _(t):
    return N.change_history(t.param_hist.select("inst_id", "date_collected", "param_name", "param_value"), ["inst_id", "param_name"], "param_value")


REGISTERED = """SELECT id AS inst_id, dblink_name, host_name, lower(database_name) AS database,
  CASE WHEN lower(instance_name) <> lower(database_name) THEN lower(instance_name) END AS instance FROM instances"""
LAST5 = "AND date_collected IN (SELECT DISTINCT date_collected FROM param_rows ORDER BY 1 DESC LIMIT 5)"


@query("r14_parameter_changes", f"""SELECT c.* EXCLUDE (spparam_value), i.* EXCLUDE (inst_id) FROM ({CHANGES.format(source=LISTS.format(cond=LAST5 + " AND param_name <> '3-MEDIUM'"), ne=NOCASE)}) c
  JOIN ({REGISTERED}) i ON i.inst_id = c.inst_id""")
def _(t):
    return C.parameter_changes(t.param_rows, t.instances, ignore=("3-MEDIUM",))


@query("r14_single_parameter_history", """SELECT date_collected, param_name, param_value FROM param_rows WHERE inst_id = 7 AND param_name = '2-HIGH' AND param_isdefault IS NOT NULL""")
def _(t):
    return C.single_parameter_history(t.param_rows, t.instances, "inst7", "2-HIGH")


@query("r14_instance_parameter_changes", f"SELECT * EXCLUDE (inst_id, spparam_value) FROM ({CHANGES.format(source=LISTS.format(cond='AND inst_id = 7'), ne=NOCASE.replace('lower', ''))}) h")
def _(t):
    return C.instance_parameter_changes(t.param_rows, t.instances, "inst7")


def _pair_side(n):
    return f"""(SELECT param_name, {lst('param_value')} AS r, {lst('spparam_value')} AS s FROM param_rows WHERE inst_id = {n} AND param_isdefault IS NOT NULL
      AND date_collected = (SELECT max(date_collected) FROM param_rows) GROUP BY 1)"""


def _unequal(a, b):
    return f"upper(coalesce({a}, 'null')) <> upper(coalesce({b}, 'null'))"


R_NE, S_NE = _unequal("a.r", "b.r"), _unequal("a.s", "b.s")


@query("r15_compare_instances", f"""SELECT coalesce(a.param_name, b.param_name) AS param_name, CASE WHEN {R_NE} AND {S_NE} THEN 'running and spfile' WHEN {R_NE} THEN 'running' ELSE 'spfile' END AS difference_in,
    a.r AS running_1, b.r AS running_2, a.s AS stored_1, b.s AS stored_2 FROM {_pair_side(1)} a FULL JOIN {_pair_side(2)} b ON a.param_name = b.param_name WHERE ({R_NE} OR {S_NE})""")
def _(t):
    return C.compare_instances(t.param_rows, t.instances, "inst1", "inst2")


LATEST_PARAMS = "(SELECT * FROM param_hist WHERE date_collected = (SELECT max(date_collected) FROM param_hist))"
LIVE_REG = f"({REGISTERED} WHERE del_date IS NULL)"


@query("r16_running_differs_from_stored", f"""SELECT h.*, i.* EXCLUDE (inst_id) FROM {LATEST_PARAMS} h JOIN {LIVE_REG} i ON i.inst_id = h.inst_id
  WHERE ((param_value IS NULL AND spparam_value IS NOT NULL) OR (param_value IS NOT NULL AND spparam_value IS NULL AND param_isdefault <> 'TRUE') OR lower(param_value) <> lower(spparam_value))
    AND param_name <> '5-LOW'""")
def _(t):
    return C.running_differs_from_stored(t.param_hist, t.instances, ignore=("5-LOW",))


@query("r16_modified_parameters", f"""SELECT h.*, i.* EXCLUDE (inst_id) FROM {LATEST_PARAMS} h JOIN {LIVE_REG} i ON i.inst_id = h.inst_id
  WHERE param_ismodified = 'MODIFIED' AND coalesce(lower(param_value), 'aaa') <> coalesce(lower(spparam_value), 'aaa')""")
def _(t):
    return C.modified_parameters(t.param_hist, t.instances)


@query("r16_text_file_start", f"""SELECT h.*, i.* EXCLUDE (inst_id) FROM (SELECT * FROM param_rows WHERE param_name = '5-LOW' AND date_collected = (SELECT max(date_collected) FROM param_rows WHERE param_name = '5-LOW')) h
  JOIN {LIVE_REG} i ON i.inst_id = h.inst_id WHERE param_value IS NULL""")
def _(t):
    return C.started_from_text_file(t.param_rows, t.instances, "5-LOW")


@query("a28_two_values", f"""SELECT dblink_name, param_name, count(*) AS cnt, min(spparam_sid) AS sid_1, CASE WHEN min(spparam_sid) <> max(spparam_sid) THEN max(spparam_sid) END AS sid_2
  FROM (SELECT * FROM param_rows WHERE date_collected = (SELECT max(date_collected) FROM param_rows)) h JOIN ({REGISTERED}) i ON i.inst_id = h.inst_id GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    return C.multi_line_parameters(t.param_rows, t.instances)


@query("a24_having_count", "SELECT inst_id, param_name, count(*) AS cnt FROM param_rows GROUP BY 1, 2 HAVING count(*) > 5")
def _(t):
    return A.count_by(t.param_rows, ["inst_id", "param_name"]).where("cnt > 5")


@query("a37_coverage", f"SELECT (SELECT count(DISTINCT id) FROM instances WHERE {PRIMARY}) AS expected, (SELECT count(DISTINCT inst_id) FROM password_hist WHERE date_collected = {DAY_SQL}) AS collected")
def _(t):
    return N.coverage(N.live_instances(t.instances, billed=True, primary=True), t.password_hist, DAY)


PROFILE_REG = f"SELECT id, lower(database_name) AS database, application, lower(host_name) AS host, status FROM instances WHERE {PRIMARY}"


@query("a38_weak_profiles", f"""SELECT database, application, host, status, password_verify_function, password_length, count(DISTINCT profile) AS profiles_affected, CAST(sum(count_users) AS BIGINT) AS users_affected
  FROM password_hist p JOIN ({PROFILE_REG}) i ON i.id = p.inst_id WHERE date_collected = (SELECT max(date_collected) FROM password_hist) AND CAST(password_length AS INT) < 8 GROUP BY 1, 2, 3, 4, 5, 6""")
def _(t):
    return C.weak_profiles(t.password_hist, t.instances)


@query("r26_password_profiles", f"""SELECT p.*, i.database, upper(i.host) AS host, i.status FROM password_hist p JOIN ({PROFILE_REG}) i ON i.id = p.inst_id
  WHERE date_collected = (SELECT max(date_collected) FROM password_hist x WHERE x.inst_id = p.inst_id)""")
def _(t):
    return C.password_profiles(t.password_hist, t.instances)


@query("r26_profile_limits", """SELECT a.profile, a.limit_value AS password_life_time, b.limit_value AS password_grace_time FROM profiles a JOIN profiles b ON b.profile = a.profile
  AND b.resource_name = 'PASSWORD_GRACE_TIME' WHERE a.resource_name = 'PASSWORD_LIFE_TIME'""")
def _(t):
    return C.profile_limits(t.profiles, ["PASSWORD_LIFE_TIME", "PASSWORD_GRACE_TIME"])


CLIENTS = ["optimizer_stats", "segment_advisor", "sql_tune_advisor", "health_monitor"]
WEEK = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]
ORD = "CASE window_name " + " ".join(f"WHEN '{d}_WINDOW' THEN {i}" for i, d in enumerate(WEEK, 1)) + " ELSE 0 END"
LBL = "CASE window_name " + " ".join(f"WHEN '{d}_WINDOW' THEN '{d[:3].title()}'" for d in WEEK) + " ELSE window_name END"
DAYS = ", ".join(f"coalesce(string_agg({LBL}, ',' ORDER BY {ORD}, {LBL}) FILTER (WHERE {c} = 'ENABLED'), 'Disabled') AS {c}" for c in CLIENTS)
SCHEDULE = f"SELECT inst_id, date_collected, {DAYS} FROM task_windows WHERE date_collected = (SELECT max(date_collected) FROM task_windows) GROUP BY 1, 2"


@query("a27_weekday_lists", f"SELECT w.*, host_name, database_name FROM ({SCHEDULE}) w JOIN instances i ON i.id = w.inst_id WHERE del_date IS NULL")
def _(t):
    return C.window_schedule(t.task_windows, t.instances, CLIENTS)


@query("r27_maintenance_schedule", f"SELECT host_name, optimizer_stats, count(*) AS cnt FROM ({SCHEDULE}) w JOIN instances i ON i.id = w.inst_id WHERE del_date IS NULL GROUP BY 1, 2")
def _(t):
    return A.count_by(C.window_schedule(t.task_windows, t.instances, ["optimizer_stats"]), ["host_name", "optimizer_stats"])


BEFORE = {"1-URGENT": "file_type", "2-HIGH": "is_default", "3-MEDIUM": "value_before", "5-LOW": "value_after"}


@query("r32_parameter_before_after", f"""SELECT id AS inst_id, lower(database_name) AS database, upper(host_name) AS host, status, file_type, is_default, value_before, value_after,
    CASE WHEN status <> 'Production' AND is_default = 'O' THEN 'change -i ' || database_name || ' from ' || coalesce(value_before, '?') END AS script
  FROM instances i LEFT JOIN (SELECT inst_id, {", ".join(f"max(param_value) FILTER (WHERE param_name = '{n}') AS {a}" for n, a in BEFORE.items())} FROM param_hist
    WHERE date_collected = {DAY_SQL} GROUP BY 1) h ON h.inst_id = i.id WHERE {BILLED}""")
def _(t):
    line = F.concat(F.lit("change -i "), F.col("database_name"), F.lit(" from "), F.coalesce("value_before", F.lit("?")))
    return C.parameter_before_after(t.param_hist, t.instances, DAY, BEFORE, line, (F.col("status") != "Production") & (F.col("is_default") == "O"))


KEYS = ["inst_id", "param_name"]


@query("j05_snapshot_difference", """SELECT coalesce(p.inst_id, c.inst_id) AS inst_id, coalesce(p.param_name, c.param_name) AS param_name, p.param_value AS previous_param_value, c.param_value AS current_param_value,
    p.spparam_value AS previous_spparam_value, c.spparam_value AS current_spparam_value,
    CASE WHEN p.inst_id IS NULL THEN 'added' WHEN c.inst_id IS NULL THEN 'deleted' WHEN p.param_value IS DISTINCT FROM c.param_value OR p.spparam_value IS DISTINCT FROM c.spparam_value THEN 'changed' ELSE 'same' END AS change,
    concat_ws(',', CASE WHEN p.param_value IS DISTINCT FROM c.param_value THEN 'param_value' END, CASE WHEN p.spparam_value IS DISTINCT FROM c.spparam_value THEN 'spparam_value' END) AS changed
  FROM (SELECT * FROM param_hist WHERE date_collected = (SELECT max(date_collected) FROM param_hist WHERE date_collected < (SELECT max(date_collected) FROM param_hist))) p
  FULL JOIN (SELECT * FROM param_hist WHERE date_collected = (SELECT max(date_collected) FROM param_hist)) c ON c.inst_id = p.inst_id AND c.param_name = p.param_name""")
def _(t):
    return N.diff_snapshots(N.previous_snapshot(t.param_hist), N.latest_snapshot(t.param_hist), KEYS, ["param_value", "spparam_value"])


@query("j33_inner_join_with_filters", "SELECT file_id, b.block_size FROM files f JOIN tablespaces b ON b.tablespace_name = f.tablespace_name WHERE f.autoextensible = 'NO'")
def _(t):
    return P.lookup(t.files, "autoextensible = 'NO'").join(t.tablespaces, "tablespace_name").select("file_id", "block_size")


@query("a25_hosts_of_profiles", f"SELECT application, {lst('DISTINCT host_name')} AS hosts FROM instances GROUP BY 1".replace("ORDER BY DISTINCT", "ORDER BY"))
def _(t):
    return t.instances.select("application", "host_name").distinct().groupBy("application").agg(agg_list("host_name").alias("hosts"))
