"""Resource-dump and scalar-function queries."""

from pyspark.sql import functions as F

from ..functions import labels, nulls, numbers, text, times
from ..operators import activity as A, filters as P
from ..plans import cluster_reports as R
from ..sources import resource_dump as D
from .registry import query

NOW = "2024-01-20 00:00:00"
NODES = ["node1", "node2", "node3"]

# The expected values come from the rule that renders the dump text, not from the text.
STATE = "CASE WHEN unit % 6 = sv THEN 'OFFLINE' ELSE 'ONLINE' END"
TARGET = "CASE WHEN unit % 7 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END"
MODE = "CASE unit % 3 WHEN 0 THEN 'Open' WHEN 1 THEN 'Readonly' ELSE 'Mounted' END"
DETAIL = "CASE unit % 5 WHEN 0 THEN 'Open' WHEN 1 THEN 'Shutdown' WHEN 2 THEN 'Readonly' WHEN 3 THEN 'Mounted' ELSE 'Open' END"
HOURS = f"CASE WHEN unit % 9 = 0 THEN 999999999999 ELSE date_diff('hour', strptime('2024-01-' || lpad(CAST(1 + unit % 28 AS VARCHAR), 2, '0') || ' 10:00:00', '%Y-%m-%d %H:%M:%S'), TIMESTAMP '{NOW}') END"
DISABLED = "(sv = 1 AND unit % 2 = 0)"
ROLE = "CASE WHEN unit % 4 = 0 THEN 'PHYSICAL_STANDBY' ELSE 'PRIMARY' END"
ROWS = f"""SELECT kind, unit, 'node' || sv AS node, {STATE} AS state, CASE WHEN kind = 'DB' THEN {MODE} ELSE {TARGET} END AS target, {DETAIL} AS details, CAST({HOURS} AS BIGINT) AS started_hours,
  {DISABLED} AS disabled, {ROLE} AS role, CASE WHEN unit % 3 = 0 THEN 'pdb1' END AS pluggable FROM dump"""


def _health(status, service=""):
    recent, issue = "coalesce(started_hours < 24 AND started_hours <> 0, false)", f"{status} IS DISTINCT FROM target"
    if service:
        return f"CASE WHEN {issue} THEN 'status issue' WHEN {recent} THEN 'recently restarted' WHEN {service} THEN 'offline as expected' ELSE 'ok' END"
    return f"CASE WHEN {recent} THEN 'recently restarted' WHEN {issue} THEN 'status issue' ELSE 'ok' END"


def _matrix(keys, status, cond, service="", extra=""):
    shown = f"upper(substr({status}, 1, 1)) || lower(substr({status}, 2)) || CASE WHEN disabled THEN ' x' ELSE '' END"
    cells = ", ".join(f"coalesce(max({shown}) FILTER (WHERE node = '{n}'), '-') AS {n}, max({_health(status, service)}) FILTER (WHERE node = '{n}') AS {n}_health" for n in NODES)
    return f"SELECT {keys}, {cells} FROM ({ROWS}) r {extra} WHERE {cond} GROUP BY ALL"


def _states(t, *kinds):
    return D.resource_states(t.dump, NOW, kinds)


@query("s10_resource_states", f"SELECT kind, node, state, target, details, started_hours, disabled, count(*) AS cnt FROM ({ROWS}) r GROUP BY ALL")
def _(t):
    return A.count_by(_states(t), ["kind", "node", "state", "target", "details", "started_hours", "disabled"])


@query("s10_dump_file_reader", "SELECT kind, count(*) AS cnt FROM dump GROUP BY 1")
def _(t):
    from ..session import scratch_dir
    path = scratch_dir(t.spark, "dump")
    t.dump.select(F.concat(F.lit("BREAK_HERE\n"), F.col("value"), F.lit("\n")).alias("value")).write.option("lineSep", "\n").text(path)
    return A.count_by(D.resource_states(D.read_resource_dump(t.spark, path), NOW), ["kind"])


@query("s11_status_lists", """SELECT 'ora.r' || c_custkey AS name, c_mktsegment AS type, CASE i WHEN 2 THEN 'OFFLINE' ELSE 'ONLINE' END AS target,
    CASE i WHEN 1 THEN 'ONLINE on n' || c_nationkey WHEN 2 THEN 'OFFLINE' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'ONLINE' ELSE 'INTERMEDIATE' END END AS state FROM customer, range(1, 4) r(i)""")
def _(t):
    return D.explode_status_lists(t.status_lists)


@query("r29_technical_resources", _matrix("'advm' AS tech_type, 'vol' || unit AS resource, '10.0.0.' || (unit % 250) AS vip", "state", "kind = 'TECH'"))
def _(t):
    return R.sorted_by(R.technical_matrix(_states(t), nodes=NODES), "tech_type", "resource")


LISTENER = "'LISTENER' || CASE WHEN unit % 2 = 0 THEN '_SCAN' ELSE '' END || unit"


@query("r29_listeners", _matrix(f"{LISTENER} AS resource, 'TCP:' || (1521 + unit % 5) AS port, CASE WHEN unit % 2 = 0 THEN 'SCAN' ELSE 'Listener' END AS listener_type", "state", "kind = 'LISTENER'"))
def _(t):
    return R.sorted_by(R.listener_matrix(_states(t)), "resource")


@query("r29_services", _matrix("'db' || (r.unit - 1) AS database, 'svc' || r.unit AS service, coalesce(pluggable, '-') AS pdb", "state", "kind = 'SERVICE'",
       "r.role <> d.role AND state <> 'ONLINE'", f"JOIN (SELECT DISTINCT unit, {ROLE} AS role FROM dump WHERE kind = 'DB') d ON d.unit = r.unit - 1").replace("unit %", "r.unit %").replace("r.r.unit", "r.unit")
       .replace(f"FROM ({ROWS.replace('unit %', 'r.unit %')}) r", f"FROM ({ROWS}) r").replace("(SELECT DISTINCT unit, CASE WHEN r.unit % 4", "(SELECT DISTINCT unit, CASE WHEN unit % 4"))
def _(t):
    return R.sorted_by(R.service_matrix(_states(t, "DB", "SERVICE"), nodes=NODES), "database", "service")


VERSION = "'1' || (2 + unit % 7) || '.1.0'"
DB_PART = _matrix(f"'db' || unit AS database, CAST(NULL AS VARCHAR) AS pdb, {VERSION} AS version, '/u01/app/' || {VERSION} || '/db' AS home, 'RAC' || CASE WHEN role = 'PRIMARY' THEN ' (P)' ELSE ' (S)' END AS database_type", "details", "kind = 'DB'")
PDB_PART = _matrix("'db' || (unit - 3) AS database, 'pdb' || unit AS pdb, CAST(NULL AS VARCHAR) AS version, CAST(NULL AS VARCHAR) AS home, 'PDB' AS database_type", "state", "kind = 'PDB'")


@query("r29_databases", f"{DB_PART} UNION ALL BY NAME {PDB_PART}")
def _(t):
    return R.sorted_by(R.database_matrix(_states(t), nodes=NODES), "database", "pdb")


@query("r29_homes", f"SELECT '/u01/app/' || {VERSION} || '/db' AS home, min('own' || (unit % 3)) AS owner, min('grp' || (unit % 2)) AS owner_group FROM dump WHERE kind = 'DB' GROUP BY 1")
def _(t):
    return R.homes(_states(t))


@query("p17_keep_and_drop_by_pattern", "SELECT database_name FROM instances WHERE regexp_matches(database_name, 'DB1') AND NOT regexp_matches(database_name, '7$')")
def _(t):
    return P.pattern_filter(t.instances, "DB1", "7$", "database_name").select("database_name")


@query("p17_only_listed", "SELECT 'db' || unit AS database FROM (SELECT DISTINCT unit FROM dump WHERE kind = 'DB' AND unit IN (5, 10, 15)) d")
def _(t):
    return P.only(_states(t).where("kind = 'DB'"), databases=["db5", "db10", "db15"]).select("database").distinct()


@query("p18_health_classes", f"SELECT kind, {_health('state')} AS health, count(*) AS cnt FROM ({ROWS}) r WHERE kind <> 'DB' GROUP BY 1, 2")
def _(t):
    return A.count_by(_states(t).where("kind <> 'DB'"), ["kind", P.health_class("state", "target", "started_hours", 24).alias("health")])


@query("p19_target_state", "SELECT CASE c_custkey % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'read only' WHEN 2 THEN 'Mount' ELSE 'read only, open' END AS open_mode, CASE c_custkey % 4 WHEN 1 THEN 'Readonly' WHEN 2 THEN 'Mounted' ELSE 'Open' END AS target, count(*) AS cnt FROM customer GROUP BY 1, 2")
def _(t):
    k = F.col("c_custkey") % 4
    mode = F.when(k == 0, "OPEN").when(k == 1, "read only").when(k == 2, "Mount").otherwise("read only, open")
    rows = t.customer.withColumn("open_mode", mode)
    return A.count_by(rows, ["open_mode", labels.target_state("open_mode").alias("target")])

# ---- scalar functions --------------------------------------------------------------------

@query("f01_null_rules", """SELECT sample_id, session_id, coalesce(sql_plan_options, 'none') AS option_or_none, CASE WHEN temp_space_allocated IS NOT NULL THEN 'temp' ELSE 'no temp' END AS temp_use,
    nullif(time_waited, 0) AS waited, concat_ws('', sql_plan_operation, ' ', sql_plan_options) AS operation FROM samples""")
def _(t):
    return t.samples.select(
        "sample_id", "session_id", nulls.first_set("sql_plan_options", F.lit("none")).alias("option_or_none"),
        nulls.if_set("temp_space_allocated", "temp", "no temp").alias("temp_use"), nulls.nz("time_waited").alias("waited"),
        nulls.glue(F.col("sql_plan_operation"), " ", F.col("sql_plan_options")).alias("operation"))


@query("f02_number_functions", """SELECT event_id, CAST(round(value, 0) AS BIGINT) AS rounded, CAST(ceil(value) AS BIGINT) AS ceiling, CAST(floor(value) AS BIGINT) AS whole, event_id % 17 AS rest, event_id & 255 AS low
  FROM (SELECT event_id, CAST(value AS DECIMAL(18,2)) AS value FROM events) e""")
def _(t):
    v = F.col("value").cast("decimal(18,2)")
    return t.events.select("event_id", F.round(v, 0).cast("bigint").alias("rounded"), F.ceil(v).cast("bigint").alias("ceiling"), F.floor(v).cast("bigint").alias("whole"),
                           (F.col("event_id") % 17).alias("rest"), F.col("event_id").bitwiseAND(255).alias("low"))


@query("f03_hex_and_numbers", "SELECT p_partkey, lpad(upper(to_hex(p_partkey)), 16, '0') AS hexed, CAST(p_partkey AS DECIMAL(20,0)) AS back, TRY_CAST(p_name AS DECIMAL(38,4)) AS not_a_number, CAST(CAST(CAST(p_size AS VARCHAR) AS DECIMAL(38,4)) AS DOUBLE) AS number FROM part")
def _(t):
    hexed = numbers.hex16("p_partkey")
    return t.part.select("p_partkey", hexed.alias("hexed"), numbers.from_hex(hexed).alias("back"), numbers.to_number("p_name").alias("not_a_number"),
                         numbers.to_number(F.col("p_size").cast("string")).cast("double").alias("number"))


@query("f04_time_formats", """SELECT event_id, strftime(ts, '%d.%m.%Y') AS day, strftime(ts, '%H:%M:%S') AS clock, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour,
    date_diff('minute', TIMESTAMP '2024-01-01 00:00:00', date_trunc('minute', ts)) AS minutes FROM events""")
def _(t):
    span = times.trunc("minute", "ts") - times.ts("2024-01-01 00:00:00")
    return t.events.select("event_id", F.date_format("ts", times.DATE_DOTTED).alias("day"), F.date_format("ts", times.SECOND).alias("clock"),
                           times.trunc("hour", "ts").alias("hour"), times.interval_minutes(span).alias("minutes"))


@query("f05_seconds_between", "SELECT o_orderkey, date_diff('second', o_orderdate, TIMESTAMP '1999-01-01 00:00:00') AS seconds FROM orders")
def _(t):
    return t.orders.select("o_orderkey", times.seconds_between("o_orderdate", times.ts("1999-01-01 00:00:00")).alias("seconds"))


@query("f06_text_functions", "SELECT p_partkey, substr(p_name, 1, instr(p_name, ' ') - 1) AS first_word, replace(p_name, ' ', '_') AS joined, lpad(CAST(p_size AS VARCHAR), 5, '0') AS padded, upper(p_type) AS up, lower(p_brand) AS low, rtrim(p_name || '   ') AS trimmed FROM part")
def _(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", F.substring(n, F.lit(1), F.instr(n, " ") - 1).alias("first_word"), F.replace(n, F.lit(" "), F.lit("_")).alias("joined"),
                         F.lpad(F.col("p_size").cast("string"), 5, "0").alias("padded"), F.upper("p_type").alias("up"), F.lower("p_brand").alias("low"), F.rtrim(F.concat(n, F.lit("   "))).alias("trimmed"))


@query("f07_patterns", r"SELECT c_custkey, regexp_replace(c_name, '\d', 'n', 'g') AS shape, regexp_replace(c_name, '[^\d]', '', 'g') AS digits, regexp_matches(c_name, '7$') AS ends_in_7 FROM customer")
def _(t):
    return t.customer.select("c_custkey", text.digits_to_n("c_name").alias("shape"), text.digits_only("c_name").alias("digits"), F.col("c_name").rlike("7$").alias("ends_in_7"))


@query("f11_hours_since", f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-03-01 00:00:00') // 3600 WHEN 1 THEN date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-03-01 00:00:00') // 3600 ELSE 999999999999 END AS hours FROM events")
def _(t):
    k = F.col("event_id") % 3
    epoch = F.timestamp_diff("SECOND", times.ts("1970-01-01 00:00:00"), F.col("ts")).cast("string")
    told = F.when(k == 0, F.date_format("ts", "MM/dd/yyyy HH:mm:ss")).when(k == 1, epoch).otherwise("NEVER")
    return t.events.select("event_id", times.hours_since(told, "2024-03-01 00:00:00").alias("hours"))


@query("f12_status_details", f"SELECT {DETAIL} AS details, count(*) AS cnt FROM dump GROUP BY 1")
def _(t):
    return A.count_by(D.parsed(t.dump), [labels.status_detail(D.attribute("STATE_DETAILS")).alias("details")])


@query("f13_duration_hours", "SELECT p_partkey, CAST(p_size AS BIGINT) * CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 24 WHEN 2 THEN 168 WHEN 3 THEN 744 WHEN 4 THEN 8760 ELSE 1 END AS hours FROM part")
def _(t):
    unit = F.try_element_at(F.array(*[F.lit(u) for u in "hdwmy"]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.part.select("p_partkey", times.duration_hours_col(F.concat(F.col("p_size").cast("string"), F.coalesce(unit, F.lit("")))).alias("hours"))


@query("f14_version_owner_group", f"SELECT {VERSION} AS version, 'own' || (unit % 3) AS owner, 'grp' || (unit % 2) AS owner_group, count(*) AS cnt FROM dump GROUP BY 1, 2, 3")
def _(t):
    acl = D.attribute("ACL")
    return A.count_by(D.parsed(t.dump), [text.version_from_path(D.attribute("ORACLE_HOME")).alias("version"), text.acl_owner(acl).alias("owner"), text.acl_group(acl).alias("owner_group")])


@query("f15_title_case", "SELECT c_mktsegment, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS title FROM customer GROUP BY 1")
def _(t):
    return t.customer.select("c_mktsegment").distinct().select("c_mktsegment", text.title_case("c_mktsegment").alias("title"))
