"""Logins, dead sessions, policies and live-session summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import return_code_label
from ..functions.numbers import count_if
from ..functions.times import MINUTE_DOTTED, SECOND, trunc, ts
from ..operators.aggregates import agg_list

# The profile limit behind a return code, and the display order of users.
LIFE_TIME, ATTEMPTS = "PASSWORD_LIFE_TIME", "FAILED_LOGIN_ATTEMPTS"
USER_ORDER = ["_BACKGROUND", "SYS", "DBSNMP", "SYSRAC", "_USER"]
JOB_PROGRAM = "oracle%(J%"
# End of fixed values.


def _failed(audit: DataFrame, start: str | None, end: str | None) -> DataFrame:
    rows = audit.where("returncode <> 0")
    if start:
        rows = rows.where(F.col("event_time") >= ts(start))
    return rows.where(F.col("event_time") < ts(end)) if end else rows


def failed_logins(audit: DataFrame, users: DataFrame, profiles: DataFrame, start: str | None = None, end: str | None = None, more_than: int = 10) -> DataFrame:
    """Failed logins per day, user and code with the hosts in one list; hosts at or below more_than attempts are left out.

    Account state and the responsible profile limit join after the aggregation.
    """
    per_host = _failed(audit, start, end).groupBy(trunc("day", "event_time").alias("day"), "username", "userhost", "returncode") \
        .agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > more_than)
    rolled = per_host.groupBy("day", "username", "returncode").agg(F.sum("cnt").alias("attempts"), agg_list("userhost").alias("hosts"))
    limit = lambda name: profiles.where(F.col("resource_name") == name).select("profile", F.concat_ws("  - ", "resource_name", "limit_value").alias(name))
    known = users.join(limit(LIFE_TIME), "profile", "left").join(limit(ATTEMPTS), "profile", "left")
    code, state = F.col("returncode"), F.col("account_status")
    at = lambda c: F.date_format(c, MINUTE_DOTTED)
    dated = lambda when: F.when(state.isNotNull(), F.concat_ws("", state, F.lit("  - "), when))
    return rolled.join(known, "username", "left").select(
        "day", "username", "returncode", return_code_label("returncode").alias("message"), "attempts", "hosts",
        F.when(code == 28001, dated(at("expiry_date"))).when(code == 28000, dated(at("lock_date")))
        .when(code == 1045, dated(F.when(state.like("%LOCK%"), at("lock_date")).when(state.like("%EXPIR%"), at("expiry_date"))))
        .when(code == 1017, F.coalesce(state, F.lit("<User does not exist>"))).alias("account"),
        F.when(code == 28001, F.col(LIFE_TIME)).when(code == 28000, F.col(ATTEMPTS)).alias("profile_setting"),
    ).orderBy(F.col("day").desc(), F.col("attempts").desc(), "username", "returncode")


def failed_logins_per(audit: DataFrame, unit: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Failed logins per time unit, user, host and code."""
    return _failed(audit, start, end).groupBy(trunc(unit, "event_time").alias("at"), "username", "userhost", "returncode").agg(
        F.count(F.lit(1)).alias("attempts")).withColumn("message", return_code_label("returncode"))


def failed_logins_hourly(audit: DataFrame, users: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Hourly failed logins of existing users with their lock and expiry dates."""
    return failed_logins_per(audit, "hour", start, end).join(users.select("username", "lock_date", "expiry_date"), "username")


def lock_reason(audit: DataFrame, usernames: list[str], start: str, end: str) -> DataFrame:
    """Every login of some users in a short time range."""
    return audit.where(F.col("username").isin(usernames) & F.col("event_time").between(ts(start), ts(end))).select(
        F.date_format("event_time", SECOND).alias("clock"), "username", "userhost", "returncode", return_code_label("returncode").alias("message"))


def failed_by_host(audit: DataFrame, start: str) -> DataFrame:
    return audit.where((F.col("returncode") != 0) & (F.col("event_time") > ts(start))).groupBy("userhost", "username").agg(F.count(F.lit(1)).alias("cnt"))


def dead_sessions(audit: DataFrame, live: DataFrame, start: str, exclude: list[str] = ()) -> DataFrame:
    """Successful logins without logoff whose session is gone."""
    rows = audit.where(F.col("logoff_time").isNull() & (F.col("event_time") > ts(start)) & (F.col("returncode") == 0) & ~F.col("username").isin(list(exclude)))
    return rows.join(live.select(F.col("audsid").alias("sessionid")), "sessionid", "left_anti")


def hourly_histogram(df: DataFrame, c: str) -> DataFrame:
    """Rows per day and hour of day."""
    return df.groupBy(F.date_format(c, "yyyy.MM.dd").alias("day"), F.date_format(c, "HH").alias("hour")).agg(F.count(F.lit(1)).alias("total"))


def user_name() -> Column:
    return F.coalesce("username", F.concat(F.lit("_"), F.col("type")))


def user_rank(c: str) -> Column:
    """Display order: background first, then the system users, then everybody."""
    out = F.when(F.col(c) == USER_ORDER[0], 1)
    for i, u in enumerate(USER_ORDER[1:], 2):
        out = out.when(F.col(c) == u, i)
    return out.otherwise(len(USER_ORDER) + 1)


def is_active() -> Column:
    return (F.col("status") == "ACTIVE") & (F.col("wait_class") != "Idle")


def sessions_by_user(sessions: DataFrame, k: int | None = 14, per_node: bool = False, more_than: int = 0) -> DataFrame:
    """Sessions and active sessions per user in display order."""
    node = ["inst_id"] if per_node else []
    out = sessions.groupBy(*node, user_name().alias("user_name")).agg(F.count(F.lit(1)).alias("sessions"), count_if(is_active()).alias("active"))
    out = out.where(F.col("sessions") > more_than)
    ordered = out.orderBy(*node, user_rank("user_name"), F.col("sessions").desc_nulls_last(), "user_name")
    return ordered.limit(k) if k else ordered


def instance_summary(sessions: DataFrame, switches: DataFrame | None = None) -> DataFrame:
    """One line: user sessions, active sessions, oldest connection, and the last log switch."""
    person = F.col("username").isNotNull() & ~F.col("program").like(JOB_PROGRAM)
    out = sessions.agg(
        count_if(person).alias("total_sessions"), count_if(is_active()).alias("active_sessions"),
        F.min(F.when(person, F.col("logon_time"))).alias("connected_since"))
    if switches is not None:
        out = out.withColumn("last_switch", switches.select(F.max("switch_time")).scalar())
    return out


def instance_check(sessions: DataFrame, switches: DataFrame) -> DataFrame:
    """The summary line and the sessions of every user, as one report."""
    top = instance_summary(sessions, switches).select(
        F.lit("summary").alias("section"), F.lit(None).cast("string").alias("user_name"), F.col("total_sessions").alias("sessions"),
        F.col("active_sessions").alias("active"), "connected_since", "last_switch")
    return top.unionByName(sessions_by_user(sessions, None).withColumn("section", F.lit("user")), allowMissingColumns=True)


def check(df: DataFrame, name: str, expected: int) -> DataFrame:
    """One compliance check: does the relation hold exactly the expected number of rows."""
    return df.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("check_name"), "found", F.lit(expected).cast("bigint").alias("expected"))


def all_checks(*checks: DataFrame) -> DataFrame:
    """Every check with its verdict, rolled up to one pass flag."""
    rows = reduce(lambda a, b: a.unionByName(b), checks)
    return rows.agg(count_if(F.col("found") == F.col("expected")).alias("passed"), F.count(F.lit(1)).alias("checks")) \
        .withColumn("compliant", F.when(F.col("passed") == F.col("checks"), "true").otherwise("false"))

