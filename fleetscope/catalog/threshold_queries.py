"""Threshold-catalogue queries."""

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.text import schedule
from ..operators import activity as A, filters as P, sets as U, snapshots as N, thresholds as T
from ..operators.joins import not_in
from ..plans import threshold_reports as C
from .registry import query

LAST = "(SELECT max(date_collected) FROM thresholds)"
PREV = f"(SELECT max(date_collected) FROM thresholds WHERE date_collected < {LAST})"
# stands in for the group that is left out
GROUP = "G3"
CUR = f"(SELECT * FROM thresholds WHERE date_collected = {LAST} AND groups_grid IS DISTINCT FROM '{GROUP}')"
BEFORE = f"(SELECT * FROM thresholds WHERE date_collected = {PREV} AND groups_grid IS DISTINCT FROM '{GROUP}')"


@query("p12_has_threshold", """SELECT line_id, target_guid, metric_guid, warning_threshold FROM settings
  WHERE nullif(trim(warning_threshold), '') IS NOT NULL OR nullif(trim(critical_threshold), '') IS NOT NULL OR nullif(trim(key_value), '') IS NOT NULL""")
def _(t):
    return P.has_threshold(t.settings).select("line_id", "target_guid", "metric_guid", "warning_threshold")


TITLES = "(SELECT metric_guid, trim(metric_label) AS title FROM metric_titles)"
STATUS = ", ".join(f"'{x}'" for x in labels.GENERIC_STATUS_LABELS)
METRIC = f"""CASE WHEN column_label IN ('User-Defined Numeric Metric', 'User Defined Numeric Metric') THEN 'UDM: ' || s.collection_name
  WHEN metric_name LIKE 'alertLog%' OR metric_name LIKE 'db_alert_log%' THEN concat_ws('', title, ' - ', column_label)
  WHEN column_label IN ({STATUS}) OR title = 'Incident' THEN concat_ws('', title, ' - ', column_label) ELSE column_label END"""


@query("p11_metric_labels", f"SELECT column_label, metric_name, {METRIC} AS metric, count(*) AS cnt FROM settings s LEFT JOIN {TITLES} m ON m.metric_guid = s.metric_guid GROUP BY 1, 2, 3")
def _(t):
    rows = t.settings.join(t.metric_titles.withColumn("title", F.trim("metric_label")), "metric_guid", "left")
    return A.count_by(rows, ["column_label", "metric_name", labels.metric_label("column_label", "metric_name", "collection_name", "title").alias("metric")])


SCHEDULE = r"""CASE WHEN trim(schedule_xml) <> '' THEN concat_ws(' ', nullif(regexp_extract(schedule_xml, 'INTERVAL="([^"]*)"', 1), ''),
  coalesce(nullif(regexp_extract(schedule_xml, 'TIME_UNIT="([^"]*)"', 1), ''), 'Min')) END"""


@query("s12_schedule_from_xml", f"SELECT target_guid, metric_guid, collection_name, {SCHEDULE} AS schedule FROM collections")
def _(t):
    return t.collections.select("target_guid", "metric_guid", "collection_name", schedule("schedule_xml").alias("schedule"))


@query("f10_schedules_in_use", f"SELECT {SCHEDULE} AS schedule, count(*) AS cnt FROM collections GROUP BY 1")
def _(t):
    return A.count_by(t.collections, [schedule("schedule_xml").alias("schedule")])


KEY = "nullif(trim(CASE WHEN column_label IN ('User-Defined Numeric Metric', 'User Defined Numeric Metric') THEN key_value2 ELSE key_value END), '')"
OPERATOR = "CASE critical_operator WHEN 0 THEN '>' WHEN 1 THEN '=' WHEN 2 THEN '<' WHEN 3 THEN '<=' WHEN 4 THEN '>=' WHEN 5 THEN 'Contains' WHEN 6 THEN '<>' WHEN 7 THEN 'Matches' ELSE CAST(warning_operator AS VARCHAR) END"


@query("j30_threshold_resolution", f"""SELECT * FROM (SELECT TIMESTAMP '2024-01-31 00:00:00' AS date_collected, target_type, target_name, groups_grid, host_name, {METRIC} AS metric, {KEY} AS key_value,
    {OPERATOR} AS comparison_operator, nullif(trim(warning_threshold), '') AS warning_threshold, nullif(trim(critical_threshold), '') AS critical_threshold, occurrence_count,
    {SCHEDULE} AS collection_frequency, is_enabled, line_id
  FROM targets t LEFT JOIN settings s ON s.target_guid = t.target_guid
  LEFT JOIN collections c ON c.target_guid = s.target_guid AND c.metric_guid = s.metric_guid AND c.collection_name = s.collection_name
  LEFT JOIN {TITLES} m ON m.metric_guid = s.metric_guid
  LEFT JOIN (SELECT member_guid, string_agg(group_name, ',' ORDER BY group_name) AS groups_grid FROM target_groups WHERE group_type = 'composite' GROUP BY 1) g ON g.member_guid = t.target_guid) x
  WHERE warning_threshold IS NOT NULL OR critical_threshold IS NOT NULL OR key_value IS NOT NULL""")
def _(t):
    return T.threshold_snapshot(t.targets, t.settings, t.collections, t.metric_titles, t.target_groups, "2024-01-31 00:00:00")


@query("j34_user_defined_metrics", """SELECT DISTINCT s.column_label, s.key_value2 FROM settings s JOIN collections c ON c.target_guid = s.target_guid AND c.metric_guid = s.metric_guid
  WHERE s.column_label LIKE 'User%Defined%'""")
def _(t):
    return T.user_metrics(t.settings, t.collections, ["target_guid", "metric_guid"], "column_label", "key_value2")


def _only(a, b, year_a, year_b):
    return f"SELECT DISTINCT target_name FROM thresholds WHERE date_collected = {a} AND target_name NOT IN (SELECT target_name FROM thresholds WHERE date_collected = {b})"


@query("j11_new_targets", _only(LAST, PREV, 0, 0))
def _(t):
    return N.added(N.previous_snapshot(t.thresholds), N.latest_snapshot(t.thresholds), "target_name")


@query("j11_deleted_targets", _only(PREV, LAST, 0, 0))
def _(t):
    return N.removed(N.previous_snapshot(t.thresholds), N.latest_snapshot(t.thresholds), "target_name")


COLS = ["metric", "key_value", "comparison_operator", "warning_threshold", "critical_threshold"]
MINE = ["target_name", *COLS]


@query("j12_history_not_latest", f"""SELECT date_collected, {', '.join(MINE)} FROM thresholds h WHERE NOT EXISTS (SELECT 1 FROM thresholds c WHERE c.date_collected = {LAST}
  AND {" AND ".join(f"c.{x} IS NOT DISTINCT FROM h.{x}" for x in MINE)})""")
def _(t):
    return T.history_not_latest(t.thresholds, MINE).select("date_collected", *MINE)


@query("j12_not_in_with_nulls", f"""SELECT date_collected, target_name, {', '.join(COLS)} FROM thresholds h WHERE ({', '.join(COLS)}) NOT IN
  (SELECT {', '.join(COLS)} FROM thresholds c WHERE c.date_collected = {LAST} AND c.target_name = 'Supplier#000000007' AND c.warning_threshold IS NOT NULL)""")
def _(t):
    latest = N.latest_snapshot(t.thresholds).where("target_name = 'Supplier#000000007' AND warning_threshold IS NOT NULL")
    return not_in(t.thresholds, latest, COLS, null_safe=False).select("date_collected", "target_name", *COLS)


SETTINGS = f"""SELECT target_type, target_name, host_name, metric, coalesce(key_value, '(not specified)') AS key_value, comparison_operator, warning_threshold, critical_threshold,
  CASE WHEN is_enabled = 0 THEN 'Disabled' ELSE collection_frequency END AS collection_frequency
  FROM thresholds WHERE date_collected = {LAST} AND groups_grid IS DISTINCT FROM '{GROUP}' AND metric <> 'Brand#9'"""
GRID = f"""WITH cur AS MATERIALIZED ({SETTINGS}), grid AS (SELECT g.target_type, g.target_name, g.host_name, m.metric, m.key_value FROM (SELECT DISTINCT target_type, metric, key_value FROM cur) m
    JOIN (SELECT DISTINCT target_type, target_name, host_name FROM cur) g ON g.target_type = m.target_type),
  filled AS (SELECT f.*, c.comparison_operator, c.warning_threshold, c.critical_threshold, c.collection_frequency FROM grid f
    LEFT JOIN cur c ON c.metric = f.metric AND c.target_type = f.target_type AND c.key_value = f.key_value AND c.target_name = f.target_name),
  grp AS (SELECT *, row_number() OVER (PARTITION BY target_type, metric, key_value ORDER BY cnt DESC, comparison_operator NULLS LAST, warning_threshold NULLS LAST, critical_threshold NULLS LAST, collection_frequency NULLS LAST) AS rnk
    FROM (SELECT target_type, metric, key_value, comparison_operator, warning_threshold, critical_threshold, collection_frequency, count(*) AS cnt FROM filled GROUP BY ALL) c),
  lines AS (SELECT target_type, metric, key_value, 1 AS is_default, 'Default value' AS target_name, NULL AS host_name, comparison_operator, warning_threshold, critical_threshold, collection_frequency, cnt
      FROM grp WHERE rnk = 1 AND comparison_operator IS NOT NULL
    UNION ALL SELECT f.target_type, f.metric, f.key_value, NULL, f.target_name, f.host_name, f.comparison_operator, f.warning_threshold, f.critical_threshold, f.collection_frequency, cnt
      FROM filled f JOIN grp g ON g.target_type = f.target_type AND g.metric = f.metric AND g.key_value = f.key_value AND g.comparison_operator IS NOT DISTINCT FROM f.comparison_operator
        AND g.warning_threshold IS NOT DISTINCT FROM f.warning_threshold AND g.critical_threshold IS NOT DISTINCT FROM f.critical_threshold
        AND g.collection_frequency IS NOT DISTINCT FROM f.collection_frequency WHERE rnk > 1)"""


def _settings(t):
    return T.current_settings(t.thresholds, ("Brand#9",), ignore_group=GROUP)


@query("j24_expected_settings", f"""{GRID} SELECT target_type, metric, key_value, count(*) AS expected, count(comparison_operator) AS present, count(*) - count(comparison_operator) AS missing
  FROM filled GROUP BY 1, 2, 3""")
def _(t):
    return T.missing_settings(_settings(t))


@query("a29_default_and_exceptions", f"{GRID} SELECT * FROM lines")
def _(t):
    return T.default_and_exceptions(_settings(t))


@query("w02_most_frequent_setting", f"{GRID} SELECT target_type, metric, key_value, warning_threshold, cnt FROM grp WHERE rnk = 1")
def _(t):
    return T.setting_groups(_settings(t)).where("rnk = 1").select("target_type", "metric", "key_value", "warning_threshold", "cnt")


LINE_ORDER = "metric NULLS LAST, is_default NULLS LAST, key_value NULLS LAST, coalesce(critical_threshold, warning_threshold) NULLS LAST, host_name NULLS LAST, target_name NULLS LAST, comparison_operator NULLS LAST, warning_threshold NULLS LAST, collection_frequency NULLS LAST"


def _shown(c, out=None):
    return f"CASE WHEN lag({c}) OVER w IS DISTINCT FROM {c} THEN {out or c} END"


@query("r21_readable_thresholds", f"""{GRID.replace("AND metric <> 'Brand#9'", "AND metric NOT IN ('Brand#9', 'Brand#8')").replace(f" AND groups_grid IS DISTINCT FROM '{GROUP}'", " AND host_name <> 'host1'")}
  SELECT *, {_shown('target_type')} AS shown_target_type, {_shown('metric')} AS shown_metric, {_shown('key_value')} AS shown_key_value, {_shown('metric', 'comparison_operator')} AS shown_operator
  FROM lines WINDOW w AS (PARTITION BY target_type ORDER BY {LINE_ORDER})""")
def _(t):
    return C.readable_thresholds(t.thresholds, ("Brand#9", "Brand#8"), ("host1",))


@query("w04_suppress_repeats", """SELECT *, CASE WHEN lag(host_name) OVER w IS DISTINCT FROM host_name THEN host_name END AS shown_host_name,
    CASE WHEN lag(status) OVER w IS DISTINCT FROM status THEN status END AS shown_status FROM (SELECT host_name, status, id FROM instances) i
  WINDOW w AS (PARTITION BY host_name ORDER BY status, id)""")
def _(t):
    return N.suppress_repeats(t.instances.select("host_name", "status", "id"), ["host_name", "status"], ["id"])


def _ne(a, b):
    return f"coalesce({a}, '0') <> coalesce({b}, '0')"


W, K = _ne("c.warning_threshold", "p.warning_threshold"), _ne("c.critical_threshold", "p.critical_threshold")
CP = "coalesce(CAST(coalesce({x}.is_enabled, 1) AS VARCHAR), '') || coalesce({x}.collection_frequency, '')"


def _arrow(a, b):
    return f"'''' || coalesce({a}, '') || ''' --> ''' || coalesce({b}, '') || ''''"


def _freq(x):
    return f"CASE WHEN {x}.is_enabled = 0 THEN 'Disabled' ELSE {x}.collection_frequency END"


@query("r19_threshold_changes", f"""SELECT coalesce(p.target_name, c.target_name) AS target_name, coalesce(p.metric, c.metric) AS metric, coalesce(p.key_value, c.key_value) AS key_value,
    coalesce(p.comparison_operator, c.comparison_operator) AS comparison_operator,
    CASE WHEN {W} THEN {_arrow('p.warning_threshold', 'c.warning_threshold')} ELSE c.warning_threshold END AS warning_change,
    CASE WHEN {K} THEN {_arrow('p.critical_threshold', 'c.critical_threshold')} ELSE c.critical_threshold END AS critical_change,
    CASE WHEN {CP.format(x='c')} <> {CP.format(x='p')} THEN {_arrow(_freq('p'), _freq('c'))} ELSE c.collection_frequency END AS schedule_change,
    CASE WHEN {W} AND {K} THEN 'Warn, Crit' WHEN {W} THEN 'Warning' WHEN {K} THEN 'Critical' END AS what_changed, strftime(p.date_collected, '%d.%m.%Y') AS previous_date
  FROM (SELECT * FROM thresholds WHERE date_collected = {PREV} AND target_name IN (SELECT target_name FROM thresholds WHERE date_collected = {LAST} AND groups_grid IS DISTINCT FROM 'XMON')) p
  FULL JOIN (SELECT * FROM thresholds WHERE date_collected = {LAST} AND target_name IN (SELECT target_name FROM thresholds WHERE date_collected = {PREV})) c
    ON p.target_name = c.target_name AND p.metric = c.metric AND p.key_value IS NOT DISTINCT FROM c.key_value
  WHERE {W} OR {K} OR coalesce(c.is_enabled, 1) <> coalesce(p.is_enabled, 1) OR {_ne('c.collection_frequency', 'p.collection_frequency')}""")
def _(t):
    return C.threshold_changes(t.thresholds, "XMON")


def _members(src):
    return f"(SELECT DISTINCT date_collected, target_type, target_name, host_name, groups_grid FROM {src} x)"


@query("r20_group_membership_changes", f"""SELECT DISTINCT p.date_collected, coalesce(p.target_type, c.target_type) AS target_type, coalesce(p.target_name, c.target_name) AS target_name,
    coalesce(p.host_name, c.host_name) AS host_name, p.groups_grid AS previous_group, c.groups_grid AS current_group,
    CASE WHEN p.target_name IS NULL THEN 'Target added' WHEN c.target_name IS NULL THEN 'Target deleted' ELSE 'Group membership changed' END AS operation
  FROM {_members(BEFORE)} p FULL JOIN {_members(CUR)} c ON p.target_name = c.target_name
  WHERE {_ne('c.groups_grid', 'p.groups_grid')} OR c.target_name IS NULL OR p.target_name IS NULL""")
def _(t):
    return C.group_changes(t.thresholds, GROUP)


TARGET = "Supplier#000000007"


@query("r22_target_history", f"""SELECT date_collected, target_type, target_name, host_name, metric, coalesce(key_value, '(not specified)') AS key_value, comparison_operator, warning_threshold, critical_threshold
  FROM thresholds h WHERE target_name = '{TARGET}' AND (date_collected = {LAST} OR NOT EXISTS (SELECT 1 FROM thresholds c WHERE c.target_name = '{TARGET}' AND c.date_collected = {LAST}
    AND {" AND ".join(f"c.{x} IS NOT DISTINCT FROM h.{x}" for x in COLS)}))""")
def _(t):
    return C.target_history(t.thresholds, TARGET)


FLAT = f"""SELECT metric, target_type, target_name, host_name, key_value, warning_threshold, critical_threshold, {_freq('c')} AS collection_frequency FROM {CUR} c
  WHERE (warning_threshold IS NOT NULL OR critical_threshold IS NOT NULL)"""


@query("r22_latest_flat_list", FLAT)
def _(t):
    return C.latest_flat(t.thresholds, ignore_group=GROUP)


@query("r22_one_metric_for_all", FLAT + " AND metric = 'Brand#5'")
def _(t):
    return C.latest_flat(t.thresholds, "Brand#5", GROUP)


@query("u01_union_all_tagged", "SELECT 'default' AS branch, metric, target_name FROM thresholds WHERE warning_threshold IS NULL UNION ALL SELECT 'set', metric, target_name FROM thresholds WHERE warning_threshold IS NOT NULL")
def _(t):
    rows = t.thresholds.select("metric", "target_name", "warning_threshold")
    return U.union_tagged({"default": rows.where("warning_threshold IS NULL"), "set": rows.where("warning_threshold IS NOT NULL")}).drop("warning_threshold")


@query("u02_union_distinct", "SELECT metric, host_name FROM thresholds WHERE is_enabled = 0 UNION SELECT metric, host_name FROM thresholds WHERE is_enabled IS NULL")
def _(t):
    rows = lambda cond: t.thresholds.where(cond).select("metric", "host_name")
    return U.union_distinct(rows("is_enabled = 0"), rows("is_enabled IS NULL"))


@query("u03_row_multiplier", "SELECT object_id, object_name, object_type, CAST(n AS INT) AS copy_no FROM objects, range(1, 9) r(n)")
def _(t):
    return U.replicate(t.objects, 8).select("object_id", "object_name", "object_type", "copy_no")
