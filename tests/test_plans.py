"""What the physical plans must and must not contain."""

import pytest

from fleetscope.catalog import load
from fleetscope.operators import filters, snapshots
from fleetscope.operators.joins import not_in
from fleetscope.plans import activity_reports

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", load().QUERIES)
def test_no_python_and_no_pairwise_join(spark, name):
    text = plan(load().QUERIES[name](spark, FOLDER))
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    """Samples as a stored table, partitioned by snapshot."""
    from fleetscope.catalog.inputs import Inputs

    path = str(tmp_path_factory.mktemp("t") / "samples")
    Inputs(spark, FOLDER).samples.write.partitionBy("snap_id").parquet(path)
    return spark.read.parquet(path)


def test_time_range_and_columns_reach_the_scan(saved):
    text = plan(activity_reports.top5_waiting(filters.between_time(saved, "2024-01-05 00:00:00", "2024-01-06 00:00:00")))
    assert "GreaterThanOrEqual(sample_time" in text and "EqualTo(session_state,WAITING)" in text
    assert "ReadSchema: struct<sample_time:timestamp_ntz,event:string,session_state:string>" in text


def test_snapshot_filter_prunes_partitions(saved):
    text = plan(filters.snap_filter(saved, (740790, 740800)).groupBy("event").count())
    assert "PartitionFilters: [isnotnull(snap_id" in text


def test_top_n_limits_groups_before_the_shuffle(saved):
    text = plan(activity_reports.top5_waiting(saved))
    assert text.count("WindowGroupLimit") == 2 and "Join" not in text


@pytest.mark.parametrize("report", [activity_reports.top2_with_redo, activity_reports.top3_with_writers, activity_reports.wide_profile])
def test_per_sample_reports_scan_once(saved, report):
    text = plan(report(saved))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_latest_snapshot_filters_by_subquery(saved):
    assert "Join" not in plan(snapshots.latest_snapshot(saved, c="snap_id"))


@pytest.mark.parametrize("name", ["p01_between_time", "p03_snapshot_range", "p03_snapshot_list", "a09_average_active", "r02_top3_with_both_writers", "r08_wait_classes_two_days"])
def test_catalogue_filters_lie_below_the_sample_windows(spark, name):
    text = plan(load().QUERIES[name](spark, FOLDER))
    below = text[text.rfind("Window ["):]
    assert "Window [" in text and "Filter (" in below and "DataFilters: []" not in below


def test_not_in_reads_a_fixed_number_of_times(spark):
    df = spark.read.parquet(f"{FOLDER}/orders.parquet").selectExpr("o_orderkey", "nullif(o_orderstatus, 'F') a", "nullif(o_custkey % 3, 1) b", "nullif(o_orderpriority, '5-LOW') c")
    text = plan(not_in(df, df.where("o_orderkey % 7 = 0"), ["a", "b", "c"], null_safe=False))
    assert text.count("FileScan") <= 8


def test_mixed_conditions_of_the_activity_report(spark, saved):
    """Conditions on samples go below the aggregation, those on users behind their join, with only the columns they name as keys."""
    from pyspark.sql import functions as F

    from fleetscope.catalog.inputs import Inputs

    t = Inputs(spark, FOLDER)
    start, end = "2024-01-01 00:00:00", "2024-12-31 00:00:00"
    both = ["session_type = 'FOREGROUND'", "username IS NOT NULL AND (username > 'C' OR wait_class = 'owner')"]
    got = activity_reports.activity_report(saved, ["event_text"], both, start, end, users=t.users, k=1000)
    text = plan(got)
    assert "EqualTo(session_type,FOREGROUND)" in text
    first = next(x for x in reversed(text.splitlines()) if "HashAggregate(keys=[" in x and "partial_count" in x)
    assert "user_id" in first and "wait_class" in first and "machine" not in first and "p1hex" not in first
    rows = activity_reports.ash_dimensions(filters.between_time(saved, start, end), []).join(t.users.select("user_id", "username"), "user_id", "left")
    want = rows.where(both[0]).where(both[1]).groupBy("event_text").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["event_text"]: r["total_seconds"] for r in got.collect()} == {r["event_text"]: r["n"] for r in want} and want


def test_thresholds_come_from_an_aggregation(spark, tmp_path):
    """Same rows as the view; day filters reach the scan, and the latest date needs neither names nor a window."""
    import datetime as dt

    from fleetscope.catalog import inputs
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    rows = [(None if i % 13 == 0 else i % 40, i % 7 if i % 11 else None, i % 5, 1 + i % 7 if i % 17 else None, float(i % 50) if i % 19 else None, float(i), "RAN"[i % 3], "OF"[i % 2],
             dt.datetime(1995 + i % 4, 5, 1) if i % 23 else None) for i in range(600)]
    tables = {"lineitem": (rows + rows[:50], line), "supplier": ([(i, f"s{i // 2}" if i else None, i * 3) for i in range(4)], "s_suppkey long, s_name string, s_nationkey int"),
              "part": ([(i, f"b{i % 2}" if i else None, i + 3 if i != 5 else None) for i in range(6)], "p_partkey long, p_brand string, p_size int")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    t = inputs.Inputs(spark, str(tmp_path))
    view = spark.sql(inputs.VIEWS["thresholds"], **{n: getattr(t, n) for n in tables})
    assert t.thresholds.schema.simpleString() == view.schema.simpleString()
    assert t.thresholds.exceptAll(view).count() == view.exceptAll(t.thresholds).count() == 0 < view.count()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    latest = plan(t.thresholds.where("date_collected = timestamp_ntz'1998-01-01 00:00:00'"))
    assert "Window" not in latest and "1998-01-01" in latest[latest.index("Join"):]
    assert "s_name" not in plan(t.thresholds.selectExpr("max(date_collected)")).split("Relation")[0]


def test_not_in_reads_its_rows_once_for_patterns(spark):
    """The distinct combinations are computed once: the rows are read for them and for the result, not for every key."""
    from fleetscope.operators.joins import not_in
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for b in rows:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(1, "a"), (1, None), (None, "b"), (3, "c"), (3, "c")], "x long, y string").mapInArrow(count, "x long, y string")
    other = spark.createDataFrame([(1, None), (2, "b")], "x long, y string")
    assert [tuple(r) for r in not_in(df, other, ["x", "y"], null_safe=False).collect()] == [(3, "c")] * 2
    assert seen.value <= 10
