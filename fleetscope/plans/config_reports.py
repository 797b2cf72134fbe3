"""Configuration drift and fleet-wide settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import weekday_label, weekday_order
from ..functions.nulls import differs, differs_nocase
from ..functions.numbers import GIB, ratio, to_number, utilisation
from ..operators import snapshots as N
from ..operators.aggregates import agg_list

# Parameters whose running and stored texts differ by nature, or that may have several lines.
ALWAYS_DIFFERENT = ["parallel_execution_message_size", "spfile", "log_buffer", "sga_max_size", "service_names"]
MULTI_LINE = [
    "spfile", "event", "control_files", "_kgl_debug", "db_file_name_convert", "log_file_name_convert", "listener_networks",
    "local_listener", "service_names", "utl_file_dir", "log_archive_dest_2", "log_archive_dest_4",
]
INSTANCE_SPECIFIC = [
    "control_files", "background_dump_dest", "core_dump_dest", "audit_file_dest", "dg_broker_config_file1",
    "dg_broker_config_file2", "diagnostic_dest", "local_listener", "user_dump_dest",
]
SCHEDULER_PLAN = "SCHEDULER[%]:%PLAN"
# End of fixed values.


def param_lists(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Multi-line parameters folded into sorted lists."""
    return rows.where(F.col("param_isdefault").isNotNull()).groupBy(*keys).agg(
        agg_list("param_value").alias("param_value"), agg_list("spparam_value").alias("spparam_value"))


def _registered(df: DataFrame, instances: DataFrame) -> DataFrame:
    reg = instances.select(
        F.col("id").alias("inst_id"), "dblink_name", "host_name", F.lower("database_name").alias("database"),
        F.when(F.lower("instance_name") != F.lower("database_name"), F.lower("instance_name")).alias("instance"))
    return df.join(reg, "inst_id")


def parameter_changes(rows: DataFrame, instances: DataFrame, collections: int = 5, ignore: tuple[str, ...] = ("service_names",)) -> DataFrame:
    """What changed, to what and when, over the last collections of every instance."""
    recent = rows.join(N.last_dates(rows, collections), N.DATE, "left_semi")
    lists = param_lists(recent.where(~F.col("param_name").isin(list(ignore))), [N.DATE, "inst_id", "param_name"])
    return _registered(N.change_history(lists.drop("spparam_value"), ["inst_id", "param_name"], "param_value"), instances) \
        .orderBy("dblink_name", F.col("changed_at").desc(), F.col(N.DATE).desc_nulls_last(), "param_name")


def single_parameter_history(rows: DataFrame, instances: DataFrame, instance: str, param: str) -> DataFrame:
    """Values of one parameter of one instance over time."""
    mine = instances.where(F.col("instance_name") == instance).select(F.col("id").alias("inst_id"))
    return (rows.where((F.col("param_name") == param) & F.col("param_isdefault").isNotNull()).join(mine, "inst_id", "left_semi")
            .select(N.DATE, "param_name", "param_value"))


def instance_parameter_changes(rows: DataFrame, instances: DataFrame, instance: str) -> DataFrame:
    """Change history of one instance over all its collections, first values included."""
    mine = instances.where(F.col("instance_name") == instance).select(F.col("id").alias("inst_id"))
    lists = param_lists(rows.join(mine, "inst_id", "left_semi"), [N.DATE, "param_name"])
    return N.change_history(lists.drop("spparam_value"), ["param_name"], "param_value", nocase=False)


def compare_instances(rows: DataFrame, instances: DataFrame, first: str, second: str) -> DataFrame:
    """Parameters that differ between two instances, in the running values, the stored ones, or both."""
    pair = instances.where(F.col("instance_name").isin(first, second)).select(F.col("id").alias("inst_id"), "instance_name")
    latest = N.latest_snapshot(rows).where(F.col("param_isdefault").isNotNull() & ~F.col("param_name").isin(INSTANCE_SPECIFIC))
    value = lambda inst, c: agg_list(F.when(F.col("instance_name") == inst, F.col(c)))
    wide = latest.join(pair, "inst_id").groupBy("param_name").agg(
        value(first, "param_value").alias("running_1"), value(second, "param_value").alias("running_2"),
        value(first, "spparam_value").alias("stored_1"), value(second, "spparam_value").alias("stored_2"))
    running = differs_nocase("running_1", "running_2", "null")
    stored = differs_nocase("stored_1", "stored_2", "null")
    return (wide.where(running | stored).where(~F.coalesce("running_1", "running_2", F.lit("")).like(SCHEDULER_PLAN))
            .withColumn("difference_in", F.when(running & stored, "running and spfile").when(running, "running").otherwise("spfile"))
            .orderBy("param_name"))


def running_differs_from_stored(hist: DataFrame, instances: DataFrame, ignore: tuple[str, ...] = tuple(ALWAYS_DIFFERENT)) -> DataFrame:
    """Parameters whose running value is not the stored one, at the latest collection."""
    run, sto = F.col("param_value"), F.col("spparam_value")
    diff = ((run.isNull() & sto.isNotNull()) | (run.isNotNull() & sto.isNull() & (F.col("param_isdefault") != "TRUE"))
            | (F.lower(run) != F.lower(sto)))
    return _registered(N.latest_snapshot(hist).where(diff & ~F.col("param_name").isin(list(ignore))),
                       instances.where("del_date IS NULL"))


def modified_parameters(hist: DataFrame, instances: DataFrame) -> DataFrame:
    """Parameters changed since start-up whose running value is not the stored one."""
    rows = N.latest_snapshot(hist).where((F.col("param_ismodified") == "MODIFIED") & differs_nocase("param_value", "spparam_value", "aaa"))
    return _registered(rows.where(F.col("param_name") != "service_names"), instances.where("del_date IS NULL"))


def started_from_text_file(hist: DataFrame, instances: DataFrame, param: str = "spfile") -> DataFrame:
    """Instances whose stored-parameter-file parameter has no value."""
    mine = hist.where(F.col("param_name") == param)
    return _registered(N.latest_snapshot(mine).where(F.col("param_value").isNull()), instances.where("del_date IS NULL"))


def multi_line_parameters(rows: DataFrame, instances: DataFrame) -> DataFrame:
    """Parameters with several lines per instance, with the two outermost stored owners."""
    sid = F.col("spparam_sid")
    return (_registered(N.latest_snapshot(rows), instances).groupBy("dblink_name", "param_name")
            .agg(F.count(F.lit(1)).alias("cnt"), F.min(sid).alias("sid_1"), F.when(F.min(sid) != F.max(sid), F.max(sid)).alias("sid_2"))
            .where("cnt > 1"))


def _latest_wide(measures: DataFrame, instances: DataFrame, names: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """Latest measures of live instances as columns, with host and database."""
    wide = N.eav_wide(N.latest_snapshot(measures), names, ["inst_id"], "name", "value", required)
    live = instances.where("del_date IS NULL").select(F.col("id").alias("inst_id"), "host_name", F.lower("database_name").alias("database"))
    return wide.join(live, "inst_id")


def repository_usage(measures: DataFrame, instances: DataFrame, names: dict[str, str], minutes: str | None = None) -> DataFrame:
    """Any set of measures per database; the column named by minutes is shown in days."""
    wide = _latest_wide(measures, instances, names)
    if minutes:
        wide = wide.withColumn(minutes, F.col(minutes).try_cast("double") / 24 / 60)
    return wide.orderBy("host_name", "database")


def limit_usage(measures: DataFrame, instances: DataFrame, limit: str, used: str) -> DataFrame:
    """Percent of a limit in use per database."""
    wide = _latest_wide(measures, instances, {limit: "limit_value", used: "used_value"})
    return wide.withColumn("usage_pct", utilisation(to_number("used_value"), to_number("limit_value"))).orderBy(F.col("usage_pct").desc_nulls_last(), "inst_id")


def value_ratio(measures: DataFrame, instances: DataFrame, num: str, den: str) -> DataFrame:
    """Ratio of two numeric parameters per database."""
    wide = _latest_wide(measures, instances, {num: "num_value", den: "den_value"})
    return wide.withColumn("ratio", F.try_divide(F.col("num_value").try_cast("double"), F.col("den_value").try_cast("double"))) \
        .orderBy(to_number("den_value").desc_nulls_first(), "inst_id")


def memory_usage(measures: DataFrame, instances: DataFrame, target: str, allocated: str, peak: str, optional: dict[str, str]) -> DataFrame:
    """Memory allocated against its target; the three sizes must be present, the others may be missing."""
    names = {target: "target_bytes", allocated: "allocated_bytes", peak: "peak_bytes", **optional}
    wide = _latest_wide(measures, instances, names, (target, allocated, peak))
    num = to_number
    return wide.select(
        "inst_id", "host_name", "database",
        *[ratio(num(f"{c}_bytes"), GIB, 1).alias(f"{c}_gb") for c in ("target", "allocated", "peak")],
        ratio(num("allocated_bytes"), num("target_bytes"), 1).alias("usage_ratio"),
        *[F.round(num(a), 0).cast("bigint").alias(a) for a in optional.values()],
    ).orderBy(F.col("usage_ratio").desc_nulls_first(), "host_name", "database")


def window_schedule(windows: DataFrame, instances: DataFrame, clients: list[str]) -> DataFrame:
    """Weekdays on which each maintenance client runs, in week order, or 'Disabled'."""
    def days(client: str) -> Column:
        on = F.when(F.col(client) == "ENABLED", F.struct(weekday_order("window_name").alias("o"), weekday_label("window_name").alias("d")))
        return F.coalesce(F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(on)), lambda x: x["d"]), ","), F.lit("")), F.lit("Disabled"))

    latest = N.latest_snapshot(windows).groupBy("inst_id", N.DATE).agg(*[days(c).alias(c) for c in clients])
    live = instances.where("del_date IS NULL").select(F.col("id").alias("inst_id"), "host_name", "database_name")
    return latest.join(live, "inst_id").orderBy("host_name", "inst_id")


def profile_limits(profiles: DataFrame, required: list[str], value: str = "limit_value") -> DataFrame:
    """Password-profile limits as columns; a profile needs all required ones."""
    return N.eav_wide(profiles, {r: r.lower() for r in required}, ["profile"], "resource_name", value, tuple(required))


def password_profiles(hist: DataFrame, instances: DataFrame) -> DataFrame:
    """Profiles of every billed primary database at its own latest collection."""
    reg = N.live_instances(instances, billed=True, primary=True).select(
        F.col("id").alias("inst_id"), F.lower("database_name").alias("database"), F.upper("host_name").alias("host"), "status")
    return N.latest_per_key(hist, ["inst_id"]).join(reg, "inst_id").orderBy("host", "database", "profile")


def weak_profiles(hist: DataFrame, instances: DataFrame, shorter_than: int = 8) -> DataFrame:
    """Profiles and users whose minimum password length is too short, at the overall latest collection."""
    reg = N.live_instances(instances, billed=True, primary=True).select(
        F.col("id").alias("inst_id"), F.lower("database_name").alias("database"), "application", F.lower("host_name").alias("host"), "status")
    weak = N.latest_snapshot(hist).where(to_number("password_length") < shorter_than)
    return weak.join(reg, "inst_id").groupBy("database", "application", "host", "status", "password_verify_function", "password_length").agg(
        F.count_distinct("profile").alias("profiles_affected"), F.sum("count_users").alias("users_affected"))


def parameter_before_after(hist: DataFrame, instances: DataFrame, date, names: dict[str, str], template: Column, when: Column) -> DataFrame:
    """Optional parameters of every billed database as columns, with a command line where one is due."""
    wide = N.eav_wide(N.on_date(hist, date), names, ["inst_id"])
    reg = N.live_instances(instances, billed=True).select(
        F.col("id").alias("inst_id"), F.lower("database_name").alias("database"), F.upper("host_name").alias("host"), "status", "database_name")
    return reg.join(wide, "inst_id", "left").withColumn("script", F.when(when, template)).drop("database_name")


def changed_between(prev: DataFrame, cur: DataFrame, sentinel: str = "null") -> DataFrame:
    """Running values that differ between two collections of the same parameter."""
    keys = ["inst_id", "param_name"]
    values = ["param_value", "spparam_value"]
    return N.diff_snapshots(prev, cur, keys, values).where(
        differs(F.upper("current_param_value"), F.upper("previous_param_value"), sentinel.upper()))
