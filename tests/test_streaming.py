"""A stream gives the rows of its batch twin; rows beyond the watermark are dropped."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from fleetscope import streaming as S

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "event_time timestamp, username string, returncode int"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def write(spark, path, data, name):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(path / name))


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    data = [(at(m), f"u{m % 2}", 1017 if m % 3 else 0) for m in range(0, 300)]
    write(spark, src, data, "a")
    write(spark, src, [(at(100000), "zz", 1017)], "a")  # moves the watermark past everything else
    read = spark.readStream.schema(SCHEMA).parquet(str(src / "a"))
    got = S.run_available(S.failed_login_windows(read, "1 hour", 10), str(tmp_path / "out"), str(tmp_path / "ck"))
    want = S.failed_login_windows(spark.read.parquet(str(src / "a")), "1 hour", 10)
    assert rows(got, "window_start", "username", "attempts") == rows(want, "window_start", "username", "attempts")
    assert got.count() == 10


def test_late_rows_are_dropped_and_restart_adds_nothing(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    stream = lambda: S.failed_login_windows(spark.readStream.schema(SCHEMA).parquet(str(src / "a")), "1 hour", 0, "10 minutes")
    write(spark, src, [(at(5), "u", 1017), (at(500), "u", 1017)], "a")
    first = rows(S.run_available(stream(), out, ck), "window_start", "attempts")
    write(spark, src, [(at(6), "u", 1017), (at(1000), "u", 1017)], "a")
    second = rows(S.run_available(stream(), out, ck), "window_start", "attempts")
    third = rows(S.run_available(stream(), out, ck), "window_start", "attempts")
    assert [r[1] for r in first] == [1] and [r[1] for r in second] == [1, 1] and second == third


def test_contention_windows_batch(spark):
    df = spark.createDataFrame([(at(0), 7, 6_000_000), (at(0), 7, 0), (at(1), 7, 0)], "sample_time timestamp, current_obj long, time_waited long")
    r = S.contention_windows(df, "5 minutes", sample="1 minute", alert_above=None).first()
    assert (r["samples"], r["avg_sessions"], r["max_us"]) == (15, 2, 6_000_000.0)


def test_wait_class_columns(spark):
    df = spark.createDataFrame([(at(0), None, "ON CPU"), (at(0), "User I/O", "WAITING")], "sample_time timestamp, wait_class string, session_state string")
    r = S.wait_class_windows(df).select("total", "on_cpu", "user_io", F.col("commit")).first()
    assert tuple(r) == (2, 1, 1, 0)


WAITS = """sample_time timestamp, sample_id long, inst_id long, session_id long, session_serial long, event string, blocking_inst_id long, blocking_session long,
    blocking_session_serial long, time_waited long, current_obj long"""


def _waits(minutes, late=()):
    """Session 1 holds object 100 + sample; 2 waits for it, 3 in open waits, 4 for a session that is not sampled, 5 for one without object."""
    out = []
    for m in minutes:
        out += [(at(m), m, 1, 1, 7, None, None, None, None, None, 100 + m % 3), (at(m), m, 1, 9, 7, None, None, None, None, None, -1),
                (at(m), m, 2, 2, 7, "W", 1, 1, 7, 1000 * m + 1, 1), (at(m), m, 2, 3, 7, "W", 1, 1, 7, 0, 2),
                (at(m), m, 1, 4, 7, "W", 1, 8, 7, 6_000_000, 3), (at(m), m, 1, 5, 7, "W", 1, 9, 7, 0, 4), (at(m), m, 1, 6, 7, "other", 1, 1, 7, 5, 5)]
    return out


def test_waits_meet_their_holder_in_the_stream(spark, tmp_path):
    from fleetscope.operators import blocking as B

    src, data = str(tmp_path / "in"), _waits(range(40))
    frame = lambda rows: spark.createDataFrame(rows, WAITS)
    frame(data + _waits([5000])).repartition(4).write.parquet(src)
    read = lambda: spark.readStream.schema(WAITS).parquet(src)
    how = ("W", "10 minutes", None, "1 minute", "2 minutes", "1 minute")
    alert = lambda: S.held_contention_windows(read(), read(), *how, alert_above=None)
    shown = ("window_start", "contended_obj", "samples", "avg_sessions", "max_us")
    got = S.run_available(alert(), str(tmp_path / "out"), str(tmp_path / "ck"))
    batch = S.held_contention_windows(frame(data), frame(data), *how, alert_above=None)
    assert rows(got, *shown) == rows(batch, *shown) and got.count() > 20
    joined = S.waits_with_holder(frame(data), frame(data), "W", "2 minutes", "1 minute")
    exact = B.blocker_object(frame(data), "W")
    assert rows(joined, "sample_id", "session_id", "contended_obj") == rows(exact, "sample_id", "session_id", "contended_obj")
    assert {r[0] for r in rows(joined, "contended_obj")} >= {100, 101, 102, 2, 3, 4}
    frame(_waits([20])).write.mode("append").parquet(src)  # far behind the watermark: dropped
    assert rows(S.run_available(alert(), str(tmp_path / "out"), str(tmp_path / "ck")), *shown) == rows(batch, *shown)
