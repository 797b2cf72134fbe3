"""Streaming alerts over the events table as a file stream."""

from pyspark.sql import functions as F

from .. import streaming as S
from ..operators.activity import class_column
from ..functions import labels
from ..functions.times import as_instant, from_instant
from ..session import scratch_dir
from ..streaming.alerts import event_windows
from .registry import query, rounded

EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE"


def _stream(t):
    return t.spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(t.folder) \
        .withColumn("at", as_instant("ts"))


def _waits(df):
    return df.where("event_type = 'error'").select("at", (F.col("event_id") % 20).alias("current_obj"),
                                                   F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.round(F.col("value") * 100).cast("bigint") * 1000).alias("time_waited"))


def _audit(df):
    code = F.when(F.col("event_type") == "error", 1017).otherwise(0)
    return df.select("at", F.col("user_id").alias("username"), code.alias("returncode"))


def _samples(df):
    wait = F.when(F.col("event_type") == "click", "User I/O").when(F.col("event_type") == "purchase", "Commit").when(F.col("event_type") == "error", "Concurrency") \
        .when(F.col("event_type") == "signup", "Network")
    return df.select("at", wait.alias("wait_class"), F.when(F.col("event_type") == "view", "ON CPU").otherwise("WAITING").alias("session_state"),
                     F.when(F.col("event_type") != "view", F.col("event_type")).alias("event"))


def _run(t, alert, name):
    out = S.run_available(alert, scratch_dir(t.spark, name), scratch_dir(t.spark, name + "-offsets"))
    times = [c for c, d in out.dtypes if d == "timestamp"]
    return out.withColumns({c: from_instant(c) for c in times})


def _closed(end, delay):
    """Only windows that the watermark has passed are emitted."""
    return f"{end} <= (SELECT max(ts) FROM events WHERE true {{cond}}) - INTERVAL {delay}"


PER_SAMPLE = """SELECT CAST(time_bucket(INTERVAL 1 MINUTE, ts) AS TIMESTAMP) AS minute, event_id % 20 AS current_obj, count(*) AS cnt,
  sum(CASE WHEN event_id % 5 = 0 THEN NULL ELSE nullif(CAST(round(value * 100) AS BIGINT) * 1000, 0) END) / nullif(count(CASE WHEN event_id % 5 = 0 THEN NULL ELSE nullif(CAST(round(value * 100) AS BIGINT) * 1000, 0) END), 0) AS mean_us
  FROM events WHERE event_type = 'error' GROUP BY 1, 2"""


@query("st1_stream_contention", f"""SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, current_obj, {rounded('sessions_sum * (CASE WHEN max_us > 5000000 THEN 10 ELSE 1 END)', 'sample_times')} AS samples,
    {rounded('sessions_sum', 'sample_times')} AS avg_sessions, max_us FROM (
  SELECT CAST(date_trunc('hour', minute) - INTERVAL (h) HOUR AS TIMESTAMP) AS window_start, current_obj, CAST(sum(cnt) AS BIGINT) AS sessions_sum, count(*) AS sample_times, max(mean_us) AS max_us
  FROM ({PER_SAMPLE}) p, range(0, 6) r(h) GROUP BY 1, 2) w WHERE sessions_sum * (CASE WHEN max_us > 5000000 THEN 10 ELSE 1 END) / sample_times > 5
  AND {_closed('window_start + INTERVAL 6 HOUR', '10 MINUTE').format(cond="AND event_type = 'error'")}""")
def _(t):
    alert = S.contention_windows(_waits(_stream(t)), "6 hours", "1 hour", "1 minute", "10 minutes", "at", alert_above=5)
    return _run(t, alert, "contention")


HELD = f"""SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, contended_obj, {rounded('sessions_sum * (CASE WHEN max_us > 5000000 THEN 10 ELSE 1 END)', 'sample_times')} AS samples,
    {rounded('sessions_sum', 'sample_times')} AS avg_sessions, max_us FROM (
  SELECT window_start, contended_obj, CAST(sum(cnt) AS BIGINT) AS sessions_sum, count(*) AS sample_times, max(mean_us) AS max_us FROM (
    SELECT CAST(time_bucket(INTERVAL 6 HOUR, a.sample_time, TIMESTAMP '1970-01-01 00:00:00') AS TIMESTAMP) AS window_start, a.sample_time, count(*) AS cnt,
      CASE WHEN b.current_obj IS NULL OR b.current_obj = -1 THEN a.current_obj ELSE b.current_obj END AS contended_obj, sum(nullif(a.time_waited, 0)) / nullif(count(nullif(a.time_waited, 0)), 0) AS mean_us
    FROM samples a LEFT JOIN samples b ON b.inst_id = a.blocking_inst_id AND b.session_id = a.blocking_session AND b.session_serial = a.blocking_session_serial
      AND b.sample_id = CASE WHEN a.time_waited = 0 THEN a.sample_id - 1 ELSE a.sample_id END
    WHERE a.event = 'enq: TX - index contention' GROUP BY 1, 2, 4) p GROUP BY 1, 2) w"""


@query("st1_stream_contention_of_holders", HELD)
def _(t):
    """Samples as a file stream, with one sample a month later that lets the watermark pass all others."""
    names = ["sample_id", "inst_id", "session_id", "session_serial", "event", "blocking_inst_id", "blocking_session", "blocking_session_serial", "time_waited", "current_obj"]
    rows, path = t.samples.select(*names, as_instant("sample_time").alias("at")), scratch_dir(t.spark, "samples")
    later = [F.lit("enq: TX - index contention").alias(c) if c == "event" else F.lit(-1).cast(rows.schema[c].dataType).alias(c) for c in names]
    rows.unionByName(rows.agg(F.max("at").alias("at")).select(*later, (F.col("at") + F.expr("INTERVAL 30 DAYS")).alias("at"))).write.parquet(path)
    read = lambda: t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(path)
    alert = S.held_contention_windows(read(), read(), "enq: TX - index contention", "6 hours", None, "1 hour", "10 minutes", "1 hour", "at", alert_above=None)
    return _run(t, alert, "held")


@query("st2_stream_failed_logins", f"""SELECT window_start, window_start + INTERVAL 12 HOUR AS window_end, username, attempts FROM (
  SELECT CAST(time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00') AS TIMESTAMP) AS window_start, user_id AS username, count(*) AS attempts FROM events WHERE event_type = 'error' GROUP BY 1, 2) w
  WHERE attempts > 1 AND {_closed('window_start + INTERVAL 12 HOUR', '10 MINUTE').format(cond="AND event_type = 'error'")}""")
def _(t):
    return _run(t, S.failed_login_windows(_audit(_stream(t)), "12 hours", 1, "10 minutes", "at"), "logins")


CLASS_OF = {"click": "User I/O", "purchase": "Commit", "error": "Concurrency", "signup": "Network"}
CLASS_COUNTS = ", ".join(f"count(*) FILTER (WHERE event_type = '{next((k for k, v in CLASS_OF.items() if v == c), 'none')}') AS {class_column(c)}" for c in labels.WAIT_CLASSES)


@query("st3_stream_wait_classes", f"""SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, * EXCLUDE (window_start) FROM (
  SELECT CAST(time_bucket(INTERVAL 10 MINUTE, ts) AS TIMESTAMP) AS window_start, count(*) AS total, count(*) FILTER (WHERE event_type = 'view') AS on_cpu, {CLASS_COUNTS} FROM events GROUP BY 1) w
  WHERE {_closed('window_start + INTERVAL 10 MINUTE', '1 MINUTE').format(cond='')}""")
def _(t):
    return _run(t, S.wait_class_windows(_samples(_stream(t)), "10 minutes", "1 minute", "at"), "classes")


@query("st3_stream_top_events_per_batch", f"""SELECT sample_time, {", ".join(f"min(event) FILTER (WHERE rnk = {k}) AS top{k}_event, min(sessions) FILTER (WHERE rnk = {k}) AS top{k}_sessions" for k in (1, 2))} FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_time ORDER BY sessions DESC, event ASC NULLS LAST) AS rnk FROM (
    SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS sample_time, CASE WHEN event_type <> 'view' THEN event_type END AS event, count(*) AS sessions FROM events GROUP BY 1, 2) e) r
  WHERE rnk <= 2 AND {_closed('sample_time + INTERVAL 1 HOUR', '1 MINUTE').format(cond='')} GROUP BY sample_time""")
def _(t):
    counts = event_windows(_samples(_stream(t)), "1 hour", "1 minute", "at")
    out = S.top_events_each_batch(counts, scratch_dir(t.spark, "ranked"), scratch_dir(t.spark, "ranked-offsets"), 2)
    return out.withColumn("sample_time", from_instant("sample_time"))
