"""Code-to-label rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import col
from .numbers import ratio  # noqa: F401  (re-exported for report modules)

# Texts and codes that results must carry unchanged.
RETURN_CODES = {
    28000: "Account is locked",
    28001: "Password is expired",
    1017: "Invalid username or password",
    1045: "User lacks CREATE SESSION privilege",
}
COMPARISON_OPERATORS = {0: ">", 1: "=", 2: "<", 3: "<=", 4: ">=", 5: "Contains", 6: "<>", 7: "Matches"}
WAIT_CLASSES = [
    "Administrative",
    "Application",
    "Cluster",
    "Commit",
    "Concurrency",
    "Configuration",
    "Network",
    "Other",
    "Scheduler",
    "System I/O",
    "User I/O",
]
BUFFER_BUSY_EVENTS = ["buffer busy waits", "gc buffer busy", "gc buffer busy acquire", "gc buffer busy release"]
WEEKDAY_WINDOWS = [
    "MONDAY_WINDOW",
    "TUESDAY_WINDOW",
    "WEDNESDAY_WINDOW",
    "THURSDAY_WINDOW",
    "FRIDAY_WINDOW",
    "SATURDAY_WINDOW",
    "SUNDAY_WINDOW",
]
USER_METRIC_LABELS = ["User-Defined Numeric Metric", "User Defined Numeric Metric"]
GENERIC_STATUS_LABELS = [
    "Status",
    "State",
    "Out of Memory",
    "Oracle Data Block Corruption",
    "Media Failure",
    "Internal SQL Error",
    "Interface Type",
    "Error Count",
    "Data Failure Detected",
    "Data Block Corruption",
    "Cluster Error",
    "Archiver Hung",
    "Redo Log Corruption",
]
# End of fixed values.


def map_code(c, mapping: dict, default=None) -> Column:
    """Label of a code; other codes give default (a literal, a column, or NULL)."""
    labels = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hit = F.try_element_at(labels, col(c))
    if default is None:
        return hit
    return F.coalesce(hit, default if isinstance(default, Column) else F.lit(default))


def return_code_label(c) -> Column:
    return map_code(col(c).cast("int"), RETURN_CODES)


def comparison_label(c, fallback) -> Column:
    return map_code(col(c).cast("int"), COMPARISON_OPERATORS, col(fallback).cast("string"))


def buffer_class(p3, classes: list[str]) -> Column:
    """The p3-th class name; beyond the list, undo header or undo data by the low 16 bits."""
    p3 = col(p3)
    names = F.array(*[F.lit(c) for c in classes])
    low = (p3.bitwiseAND(F.lit(65535)) - 17) % 2
    undo = F.when(low == 0, "undo header").when(low == 1, "undo data").otherwise("error")
    listed = F.when(p3 >= 1, F.try_element_at(names, p3.cast("int")))
    return F.when(p3 <= len(classes), listed).otherwise(undo)


def event_label(event, session_state, p3, classes: list[str]) -> Column:
    """Event, or the session state when not waiting; buffer waits carry the buffer class."""
    base = F.coalesce(col(event), col(session_state))
    suffix = F.when(
        col(event).isin(BUFFER_BUSY_EVENTS),
        F.concat(F.lit(" ["), F.coalesce(buffer_class(p3, classes), F.lit("")), F.lit("]")),
    )
    return F.concat_ws("", base, suffix)


def metric_label(column_label, metric_name, collection_name, metric_title) -> Column:
    """Readable metric name: user-defined, alert-log and generic metrics get a composite one."""
    column, metric = col(column_label), col(metric_name)
    composite = F.concat_ws("", col(metric_title), F.lit(" - "), column)
    return (
        F.when(column.isin(USER_METRIC_LABELS), F.concat(F.lit("UDM: "), F.coalesce(col(collection_name), F.lit(""))))
        .when(metric.startswith("alertLog") | metric.startswith("db_alert_log"), composite)
        .when(column.isin(GENERIC_STATUS_LABELS) | (col(metric_title) == "Incident"), composite)
        .otherwise(column)
    )


def weekday_order(window) -> Column:
    return map_code(window, {w: i + 1 for i, w in enumerate(WEEKDAY_WINDOWS)}, 0)


def weekday_label(window) -> Column:
    short = {w: w[:3].title() for w in WEEKDAY_WINDOWS}
    return map_code(window, short, col(window))


def target_state(open_mode) -> Column:
    """Expected state from the open mode; the last matching rule wins."""
    m = F.lower(col(open_mode))
    return (
        F.when(m.contains("open"), "Open")
        .when(m.contains("read only"), "Readonly")
        .when(m.contains("mount"), "Mounted")
    )


# State-detail patterns in order of precedence.
DETAIL_RULES = {
    "instance shutdown": "Shutdown",
    "readonly": "Readonly",
    "abnormal termination": "Abnorm Term",
    "fast-start failover": "FastFailover",
    "mount": "Mounted",
    "running from old": "Open from old OH",
}


def status_detail(details) -> Column:
    """Short state from the state-details text; the first matching rule wins."""
    text = F.regexp_replace(F.regexp_replace(col(details), r",HOME=.*$", ""), r"\),.*$", ")")
    rules = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(v).alias("label")) for p, v in DETAIL_RULES.items()])
    hits = F.filter(rules, lambda r: F.contains(F.lower(text), r["pattern"]))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["label"], F.nullif(text, F.lit("")))
