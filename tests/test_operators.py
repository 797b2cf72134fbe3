"""Small hand-written frames: ties, NULL keys, zero denominators, odd texts."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fleetscope.functions import labels, nulls, numbers, text, times
from fleetscope.functions.nulls import desc
from fleetscope.operators import filters, joins, sets, snapshots, thresholds, topn
from fleetscope.operators.aggregates import agg_list
from fleetscope.plans import audit_reports, config_reports, storage_reports
from fleetscope.sources import fleet, samples, scripts


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("num, den, scale, want", [(5, 2, 0, 3), (1, 0, 0, None), (25, 10, 0, 3), (1, 3, 2, 0.33), (-5, 2, 0, -3), (125, 100, 1, 1.3), (None, 5, 0, None)])
def test_ratio(spark, num, den, scale, want):
    assert one(spark, numbers.ratio(F.lit(num).cast("bigint"), den, scale)) == want


def test_big_ratio_beyond_twenty_digits(spark):
    n = F.lit("1" + "0" * 25).cast("decimal(38,0)")
    assert one(spark, numbers.ratio(n, F.lit("1" + "0" * 24).cast("decimal(38,0)"), 1)) == 10.0


@pytest.mark.parametrize("num, den, scale", [(10**30, 3 * 10**29, 8), (-7 * 10**29, 10**30, 3), (5 * 10**17, 10**18, 0), (2 * 10**29 - 1, 4 * 10**29, 0), (123456789012345678, 10**12 + 1, 8)])
def test_ratio_with_wide_divisors(spark, num, den, scale):
    from decimal import ROUND_HALF_UP, localcontext

    with localcontext(prec=80):
        want = (Decimal(num) / Decimal(den)).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP)
    got = one(spark, numbers.ratio(F.lit(str(num)).cast("decimal(38,0)"), F.lit(str(den)).cast("decimal(38,0)"), scale))
    assert got == (int(want) if scale == 0 else float(want))


@pytest.mark.parametrize("scale", [0, 1, 3, 8])
def test_ratio_is_the_same_on_both_sides_of_the_bigint_path(spark, scale):
    from decimal import ROUND_HALF_UP, localcontext

    most = numbers.PLAIN_MOST // 10**scale
    pairs = [(s * n, t * d) for n in (0, 1, 5, most - 1, most, most + 1, 2**63 - 1) for d in (0, 1, 2, 3, 20, numbers.PLAIN_MOST, numbers.PLAIN_MOST + 1)
             for s in (1, -1) for t in (1, -1) if n // max(d, 1) < 2**62 // 10**scale or scale]
    df = spark.createDataFrame([(Decimal(n), Decimal(d)) for n, d in pairs], "n decimal(38,0), d decimal(38,0)")
    for r in df.select("n", "d", numbers.ratio("n", "d", scale).alias("v")).collect():
        if r["d"] == 0:
            assert r["v"] is None
            continue
        with localcontext(prec=80):
            want = (r["n"] / r["d"]).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP)
        assert r["v"] == (int(want) if scale == 0 else float(want.scaleb(scale)) / 10.0**scale), r
        assert str(r["v"]) != "-0.0"


def test_hex_is_unsigned(spark):
    assert one(spark, numbers.from_hex(F.lit("F" * 16))) == 2**64 - 1
    assert one(spark, numbers.from_hex(F.lit("0A"))) == 10


def test_null_rules(spark):
    assert one(spark, nulls.glue(F.lit("a"), F.lit(None).cast("string"), "b")) == "ab"
    assert one(spark, nulls.null_if_empty(F.lit(""))) is None
    assert one(spark, nulls.ne_or_null(F.lit(None).cast("string"), "X")) is True
    assert one(spark, nulls.differs(F.lit("0"), F.lit(None).cast("string"))) is True
    assert one(spark, nulls.differs(F.lit("0"), F.lit(None).cast("string"), "0")) is False  # the sentinel equals NULL


def test_unsigned_signature(spark):
    df = spark.createDataFrame([(Decimal("10602832839598511493"),)], "s decimal(20,0)")
    assert df.where(F.col("s") == F.lit("10602832839598511493").cast("decimal(20,0)")).count() == 1


@pytest.mark.parametrize("program, kind, want", [("db@h1 (P003)", "FOREGROUND", "(Pnnn) "), ("db@h (LGWR)", "BACKGROUND", "(LGWR) "), ("app7@h2 (TNS V1-V3)", "FOREGROUND", "(appn) "), ("tool", "FOREGROUND", "(tool) "), (None, "FOREGROUND", "() "), (None, "BACKGROUND", " ")])
def test_program_label(spark, program, kind, want):
    assert one(spark, text.program_label(F.lit(program).cast("string"), F.lit(kind))) == want


@pytest.mark.parametrize("path, want", [("/u01/app/oracle/product/19.0.0/db_1", "19.0.0"), ("/u01/12.2.0.1/grid", "12.2.0.1"), ("/u01/home2", None), (None, None)])
def test_version_from_path(spark, path, want):
    assert one(spark, text.version_from_path(F.lit(path).cast("string"))) == want


@pytest.mark.parametrize("xml, want", [("<Schedule><IntervalSchedule INTERVAL='24' TIME_UNIT='Hr'/></Schedule>", "24 Hr"), ('<Schedule A="1"><IntervalSchedule INTERVAL="5"/></Schedule>', "5 Min"), ("", None), (None, None), ("  ", None)])
def test_schedule(spark, xml, want):
    df = spark.createDataFrame([(xml,)], "x string")
    assert df.select(text.schedule("x").alias("v")).first()["v"] == want


def test_durations_and_hours(spark):
    assert [times.duration_hours(x) for x in ("7", "2d", "3w", "1m", "1y")] == [7, 48, 504, 744, 8760]
    assert one(spark, times.hours_since(F.lit("01/02/2024 10:00:00"), "2024-01-03 09:30:00")) == 23
    assert one(spark, times.hours_since(F.lit("1704189600"), "2024-01-03 09:30:00")) == 23
    assert one(spark, times.hours_since(F.lit("NEVER"), "2024-01-03 09:30:00")) == times.NEVER_HOURS


def test_interval_minutes(spark):
    assert one(spark, times.interval_minutes(F.expr("INTERVAL '8 01:30:00' DAY TO SECOND"))) == 8 * 1440 + 90


def test_instant_round_trip(spark):
    t = dt.datetime(2024, 5, 6, 7, 8, 9, 123456)
    df = spark.createDataFrame([(t,)], "t timestamp_ntz")
    assert df.select(times.from_instant(times.as_instant("t")).alias("t")).first()["t"] == t


@pytest.mark.parametrize("details, want", [("Open,HOME=/u01", "Open"), ("Instance Shutdown", "Shutdown"), ("Open,Readonly", "Readonly"), ("Mounted (Closed),Readonly,Open Initiated", "Mounted"),
                                           ("Abnormal Termination", "Abnorm Term"), ("Running from Old Home", "Open from old OH"), ("", None), ("Starting", "Starting")])
def test_status_detail(spark, details, want):
    df = spark.createDataFrame([(details,)], "x string")
    assert df.select(labels.status_detail("x").alias("v")).first()["v"] == want


def test_buffer_class(spark):
    classes = ["data block", "sort block", "header"]
    df = spark.createDataFrame([(0,), (1,), (3,), (17,), (18,), (None,)], "p3 long")
    assert [r[0] for r in df.select(labels.buffer_class("p3", classes)).collect()] == [None, "data block", "header", "undo header", "undo data", "error"]


def test_top_n_equals_self_joins(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, None, 3), (2, "c", 1), (3, "d", 2), (3, "e", 9), (3, "f", 4), (3, "g", 4)], "k int, item string, n long")
    order = [desc("n"), nulls.asc("item")]
    wide = topn.top_n_wide(df, ["k"], ["item", "n"], order, 3)
    ranked = topn.rank_in(df, ["k"], order)
    joined = ranked.where("rnk = 1").select("k", F.col("item").alias("i1"), F.col("n").alias("n1"))
    for r in (2, 3):
        joined = joined.join(ranked.where(f"rnk = {r}").select("k", F.col("item").alias(f"i{r}"), F.col("n").alias(f"n{r}")), "k", "left")
    assert rows(wide, "k", *[f"top{r}_{c}" for r in (1, 2, 3) for c in ("item", "n")]) == rows(joined, "k", *[f"{c}{r}" for r in (1, 2, 3) for c in ("i", "n")])


def test_shared_ranks_leave_the_next_one_empty(spark):
    df = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, "c", 3)], "k int, item string, n long")
    r = topn.top_n_wide(df, ["k"], ["item", "n"], [desc("n")], 3, ties="rank").first()
    assert (r["top1_item"], r["top2_item"], r["top3_item"]) == ("a", None, "c")


def test_null_order_in_windows(spark):
    df = spark.createDataFrame([(1, None), (1, 7)], "k int, n long")
    assert rows(topn.rank_in(df, ["k"], [desc("n")]), "n", "rnk") == [(7, 2), (None, 1)]


@pytest.mark.parametrize("null_safe, want", [(True, [("b", "2"), ("c", None), ("d", "4")]), (False, [("b", "2"), ("d", "4")])])
def test_not_in(spark, null_safe, want):
    left = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4"), ("n", None)], "x string, y string")
    right = spark.createDataFrame([("a", "1"), ("c", "9"), ("n", None)], "x string, y string")
    assert rows(joins.not_in(left, right, ["x", "y"], null_safe), "x", "y") == want


def test_not_in_with_an_all_null_combination_keeps_nothing(spark):
    left = spark.createDataFrame([("a", "1")], "x string, y string")
    right = spark.createDataFrame([(None, None)], "x string, y string")
    assert joins.not_in(left, right, ["x", "y"], null_safe=False).count() == 0
    assert joins.not_in(left, right.limit(0), ["x", "y"], null_safe=False).count() == 1


def test_capped_join_count_equals_join(spark):
    a = spark.createDataFrame([("i",)] * 4 + [("t",)] * 3 + [("z",)], "k string")
    b = spark.createDataFrame([("i",)] * 5 + [("t",)] * 2 + [(None,)], "k string")
    n = a.join(b, "k").count()
    assert joins.capped_join_count(a, b, "k", 10**9).first()[0] == n == 26
    assert joins.capped_join_count(a, b, "k", 7).first()[0] == 7


def test_running_stored_strict_shows_null_values_twice(spark):
    run = spark.createDataFrame([("p", None), ("q", "1"), ("event", "a"), ("event", "b")], "name string, value string")
    sto = spark.createDataFrame([("p", "5"), ("q", "2"), ("event", "b"), ("event", "c")], "name string, value string")
    loose = joins.match_running_stored(run, sto, ["event"])
    assert rows(loose, "name", "running_value", "stored_value") == [("event", "a", None), ("event", "b", "b"), ("event", None, "c"), ("p", None, "5"), ("q", "1", "2")]
    strict = joins.match_running_stored(run, sto, ["event"], strict=True)
    assert [r for r in rows(strict, "name", "running_value", "stored_value") if r[0] == "p"] == [("p", None, "5"), ("p", None, None)]


def test_diff_matches_null_keys(spark):
    prev = spark.createDataFrame([("a", None, "1"), ("b", "k", "2"), ("c", "k", None)], "t string, k string, v string")
    cur = spark.createDataFrame([("a", None, "9"), ("c", "k", "0"), ("d", None, "4")], "t string, k string, v string")
    assert rows(snapshots.diff_snapshots(prev, cur, ["t", "k"], ["v"]), "t", "change") == [("a", "changed"), ("b", "deleted"), ("c", "changed"), ("d", "added")]
    assert rows(snapshots.diff_snapshots(prev, cur, ["t", "k"], ["v"], sentinel="0"), "t", "change")[2] == ("c", "same")


def day(n):
    return dt.datetime(2024, 1, n)


def test_change_history(spark):
    h = spark.createDataFrame([("p", day(1), "A"), ("p", day(2), "a"), ("p", day(3), "B"), ("p", day(4), None)], "name string, date_collected timestamp_ntz, v string")
    assert rows(snapshots.change_history(h, ["name"], "v"), "v", "changed_to", "changed_at") == [("B", None, day(4)), ("a", "B", day(3))]


def test_param_report_strict_drops_stale_instances(spark):
    reg = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    hist = spark.createDataFrame([(1, day(2), "p", "x", "x"), (2, day(1), "p", "y", "y")], "inst_id long, date_collected timestamp_ntz, param_name string, param_value string, spparam_value string")
    assert rows(snapshots.param_report(reg, hist, "p"), "id", "param_value") == [(1, "x"), (2, None), (3, None)]
    assert rows(snapshots.param_report(reg, hist, "p", strict_where=True), "id", "param_value") == [(1, "x"), (3, None)]


def test_missing_settings_and_exceptions(spark):
    cur = spark.createDataFrame(
        [("db", f"t{i}", "h", "cpu", "-", ">", "80" if i < 5 else "90", None, "5 Min") for i in range(6)] + [("db", "t0", "h", "io", "-", ">", "1", None, None)],
        "target_type string, target_name string, host_name string, metric string, key_value string, comparison_operator string, warning_threshold string, critical_threshold string, collection_frequency string")
    assert rows(thresholds.missing_settings(cur), "metric", "expected", "present", "missing") == [("cpu", 6, 6, 0), ("io", 6, 1, 5)]
    got = rows(thresholds.default_and_exceptions(cur), "metric", "target_name", "warning_threshold", "cnt")
    # lacking 'io' is what most targets share, so only the one that has it is an exception
    assert got == [("cpu", "Default value", "80", 5), ("cpu", "t5", "90", 1), ("io", "t0", "1", 1)]


def test_suppress_repeats(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", None, 3), ("b", "x", 4)], "g string, m string, n int")
    assert rows(snapshots.suppress_repeats(df, ["g", "m"], ["n"]), "n", "shown_g", "shown_m") == [(1, "a", "x"), (2, None, None), (3, None, None), (4, "b", "x")]


def test_idle_filter_keeps_long_network_sends(spark):
    df = spark.createDataFrame([("SQL*Net message to client", 10), ("SQL*Net message to client", 5000), ("rdbms ipc message", 9), ("x idle wait", 1), ("io", 1)], "event string, wait_time_micro long")
    assert rows(filters.drop_idle(df), "event", "wait_time_micro") == [("SQL*Net message to client", 5000), ("io", 1)]


def test_union_distinct_collapses_equal_counts(spark):
    a = spark.createDataFrame([(3,)], "i long")
    assert sets.union_distinct(a, a, spark.createDataFrame([(4,)], "i long")).agg(F.sum("i")).first()[0] == 7
    assert sets.replicate(a, 8).count() == 8


def test_agg_list_skips_nulls(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "x string")
    assert df.agg(agg_list("x")).first()[0] == "a,b"
    assert df.where("x IS NULL").agg(agg_list("x")).first()[0] is None


def test_collect_at_once(spark, tmp_path):
    """One job for all sources: those that fail become rows and keep what they had, faults of the program fail the job."""
    path, state = str(tmp_path / "snap"), str(tmp_path / "closed")

    def connect(source):
        import os

        import pyarrow as pa
        if source["id"] == 5:
            raise ConnectionError("not reachable\nno listener")
        yield pa.RecordBatch.from_pydict({"v": [source["id"], source["id"] * 10], "name": ["a", None]})
        if source["id"] == 9 and os.path.exists(state):
            raise fleet.SourceError("link closed while reading")
        if source["id"] == 11:
            yield pa.RecordBatch.from_pydict({"v": pa.array([], pa.int64()), "name": pa.array([], pa.string())})

    collect = lambda ids: fleet.collect_at_once(ids, connect, "v long, name string", "2024-01-01", path, "demo")
    first = collect(spark.range(1, 76)).collect()
    assert [(r["inst_id"], r["collector"], r["error"]) for r in first] == [(5, "demo", "not reachable\nno listener")]
    open(state, "w").close()
    assert [r["error"] for r in collect(spark.range(9, 10)).collect()] == ["link closed while reading"]
    got = spark.read.parquet(path)
    assert rows(got, "inst_id", "v", "name") == sorted(((i, v, n) for i in range(1, 76) if i != 5 for v, n in ((i, "a"), (i * 10, None))),
                                                       key=lambda t: tuple((x is None, str(x)) for x in t))
    assert fleet.source_rows(spark.range(0), connect, "v long, name string").count() == 0
    with pytest.raises(Exception, match="ZeroDivisionError"):
        fleet.source_rows(spark.range(1), lambda source: iter([1 // source["id"]]), "v long").collect()


def test_collect_fleet_keeps_other_sources(spark, tmp_path):
    path, state = str(tmp_path / "day"), {"value": 1}

    def read(row):
        if row["id"] == 2:
            raise RuntimeError("down\nfor long")
        if row["id"] == 3:
            raise ConnectionError()
        df = spark.createDataFrame([(row["id"] * 10 + state["value"],)], "v long")
        return df.withColumn("v", F.when(F.col("v") > 0, F.raise_error(F.lit("lost"))).cast("long")) if row["id"] == 4 else df

    errors = {r["inst_id"]: r["error"] for r in fleet.collect_fleet(spark.range(1, 76), read, "2024-01-01", path, "demo").collect()}
    assert set(errors) == {2, 3, 4} and errors[2] == "down\nfor long" and errors[3] == "ConnectionError" and "lost" in errors[4]
    state["value"] = 2
    fleet.collect_fleet(spark.range(7, 8), read, "2024-01-01", path, "demo")
    got = {r["inst_id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {i: i * 10 + (2 if i == 7 else 1) for i in range(1, 76) if i not in (2, 3, 4)}


def test_snapshot_write_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "h")
    df = spark.createDataFrame([(1, day(1), "a"), (1, day(2), "b")], "inst_id long, date_collected timestamp_ntz, v string")
    fleet.write_snapshot(df, path)
    fleet.write_snapshot(df.where(F.col("v") == "b").withColumn("v", F.lit("c")), path)
    assert rows(spark.read.parquet(path), "v") == [("a",), ("c",)]


def test_extract_and_script_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", "cmd 1"), ("y", None)], "k string, line string")
    samples.save_extract(df, "k = 'x'", str(tmp_path / "e"))
    assert samples.read_samples(spark, str(tmp_path / "e"), samples.ARCHIVE_WEIGHT).first()["weight"] == 10
    scripts.write_script(df, str(tmp_path / "s"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "s")).collect()] == ["cmd 1"]


def test_memory_report_flags_down_instances(spark):
    m = spark.createDataFrame([(1, "a", str(3 * 2**20)), (1, "b", "0")], "inst_id long, name string, value string")
    reg = spark.createDataFrame([(1, "one"), (2, "two")], "id long, instance_name string")
    assert rows(storage_reports.memory_report(m, reg, {"a": "a_mb", "b": "b_mb"}), "instance", "a_mb", "note") == [("Total", 3, None), ("one", 3, None), ("two", None, "Database is down")]


def test_compliance_needs_every_check(spark):
    df = spark.range(3)
    assert audit_reports.all_checks(audit_reports.check(df, "x", 3), audit_reports.check(df, "y", 3)).first()["compliant"] == "true"
    assert audit_reports.all_checks(audit_reports.check(df, "x", 3), audit_reports.check(df, "y", 0)).first()["compliant"] == "false"


def test_failed_logins_drop_quiet_hosts_before_the_roll_up(spark):
    t = dt.datetime(2024, 1, 1, 5)
    audit = spark.createDataFrame([(t, "u", "h1", 1017)] * 12 + [(t, "u", "h2", 1017)] * 10 + [(t, "u", "h3", 1017)] * 11, "event_time timestamp_ntz, username string, userhost string, returncode int")
    users = spark.createDataFrame([], "username string, profile string, account_status string, lock_date timestamp_ntz, expiry_date timestamp_ntz")
    profiles = spark.createDataFrame([], "profile string, resource_name string, limit_value string")
    r = audit_reports.failed_logins(audit, users, profiles).first()
    assert (r["attempts"], r["hosts"], r["account"]) == (23, "h1,h3", "<User does not exist>")


def test_two_instance_compare_uses_text_null_sentinel(spark):
    rows_ = [(1, day(1), "p", "A", None, None), (2, day(1), "p", "a", None, None), (1, day(1), "q", "x", "x", None), (2, day(1), "q", "x", None, None)]
    df = spark.createDataFrame(rows_, "inst_id long, date_collected timestamp_ntz, param_name string, param_value string, spparam_value string, d string").withColumn("param_isdefault", F.lit("TRUE"))
    inst = spark.createDataFrame([(1, "i1"), (2, "i2")], "id long, instance_name string")
    assert rows(config_reports.compare_instances(df, inst, "i1", "i2"), "param_name", "difference_in") == [("q", "spfile")]


def test_snapshot_files_follow_days_not_sources(spark, tmp_path):
    path = str(tmp_path / "h")
    df = spark.range(600).selectExpr("nullif(id, 0) AS inst_id", "timestamp_ntz'2024-01-01' + make_dt_interval(id % 2) AS date_collected", "'a' AS v")
    df = df.union(df.where("inst_id = 8"))
    fleet.write_snapshot(df, path)
    again = df.where("inst_id = 7 OR inst_id IS NULL").select("inst_id", "date_collected", F.lit("b").alias("v"))
    for _ in range(2):
        fleet.write_snapshot(again, path)
    got = rows(spark.read.parquet(path), "inst_id", "v")
    assert got == sorted(((i or None, "b" if i in (0, 7) else "a") for i in [*range(600), 8]), key=lambda t: tuple((x is None, str(x)) for x in t))
    assert len(list((tmp_path / "h").rglob("*.parquet"))) <= 2 * fleet.SLOTS


def test_sources_that_share_files(spark, tmp_path):
    """Sources of one group read its files once; one without rows is not reachable."""
    path, landing = str(tmp_path / "snap"), str(tmp_path / "landing")
    held = spark.range(300).where("id % 3 <> 0").withColumn(fleet.SLOT, fleet.slot_of("id", 4)).selectExpr("id", "'p' AS name", fleet.SLOT)
    held.repartition(fleet.SLOT).write.partitionBy(fleet.SLOT).parquet(landing)
    registry = spark.range(310).withColumn(fleet.SLOT, fleet.slot_of("id", 4)).withColumn(fleet.SLOT, F.when(F.col("id") >= 300, 9).otherwise(F.col(fleet.SLOT)))
    errors = fleet.collect_at_once(registry, fleet.grouped_rows(landing, ["name"]), "name string", "2024-01-01", path, group=fleet.SLOT)
    assert rows(errors, "inst_id", "error") == sorted(((i, f"source {i} has nothing to read") for i in range(310) if i % 3 == 0 or i >= 300), key=lambda t: str(t[0]))
    assert rows(spark.read.parquet(path), "inst_id", "name") == sorted(((i, "p") for i in range(300) if i % 3), key=lambda t: str(t[0]))


def test_threshold_snapshot_moves_settings_three_times(spark):
    """Titles meet the settings before they are moved by other keys, targets and their groups come last; targets without settings have no row."""
    from fleetscope.operators.thresholds import threshold_snapshot

    targets = spark.createDataFrame([(1, "a", "host", "h1"), (2, "b", "host", "h2"), (3, "c", "host", "h3"), (None, "d", "host", "h4")], "target_guid long, target_name string, target_type string, host_name string")
    settings = spark.createDataFrame([
        (1, 10, 100, "Status", "load", "c1", " k ", None, 0, 9, " ", " 5 ", 1), (1, 11, 101, "Free", "load", "c2", " ", None, 2, 9, "7", None, 2),
        (2, 10, 102, "Free", "load", "c1", " ", None, 1, 9, " ", None, 3), (None, 10, 103, "Free", "load", "c1", "k", None, 1, 9, "1", None, 4), (9, 10, 104, "Free", "load", "c1", "k", None, 1, 9, "1", None, 4)],
        "target_guid long, metric_guid long, line_id long, column_label string, metric_name string, collection_name string, key_value string, key_value2 string, "
        "critical_operator int, warning_operator int, warning_threshold string, critical_threshold string, occurrence_count int")
    collections = spark.createDataFrame([(1, 10, "c1", 1, '<Schedule><IntervalSchedule INTERVAL="5"/></Schedule>')], "target_guid long, metric_guid long, collection_name string, is_enabled int, schedule_xml string")
    titles = spark.createDataFrame([(10, "T ")], "metric_guid long, metric_label string")
    groups = spark.createDataFrame([(1, "G2", "composite"), (1, "G1", "composite")], "member_guid long, group_name string, group_type string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = threshold_snapshot(targets, settings, collections, titles, groups, "2024-01-31 00:00:00")
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 9
        assert rows(out, "target_name", "metric", "key_value", "comparison_operator", "warning_threshold", "critical_threshold", "collection_frequency", "groups_grid", "line_id") == [
            ("a", "Free", None, "<", "7", None, None, "G1,G2", 101), ("a", "T - Status", "k", ">", None, "5", "5 Min", "G1,G2", 100)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
