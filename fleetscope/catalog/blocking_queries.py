"""Blocking queries: blocker levels, chains, hang trees and contention."""

from pyspark.sql import functions as F

from ..functions import text
from ..functions.nulls import glue
from ..operators import blocking as B
from .activity_queries import END, PROGRAM_LABEL, START
from .registry import query, rounded

LEVEL_COLS = ("inst_id", "session_id", "session_serial", "sql_id", "event")
HOP = "LEFT JOIN samples b{k} ON b{k}.sample_time = {p}.sample_time AND b{k}.inst_id = {p}.blocking_inst_id AND b{k}.session_id = {p}.blocking_session AND b{k}.session_serial = {p}.blocking_session_serial"


@query("j14_blocking_levels", f"""SELECT a.sample_time, a.inst_id, a.session_id, a.session_serial, a.sql_id, a.event,
    {", ".join(f"b{k}.{c} AS b{k}_{c}" for k in (1, 2, 3) for c in LEVEL_COLS)}
  FROM samples a {" ".join(HOP.format(k=k, p="a" if k == 1 else f"b{k - 1}") for k in (1, 2, 3))}
  WHERE coalesce(a.event, '1') <> 'log file sync'""")
def _(t):
    return B.blocking_levels(t.samples, 3, where=~F.col("event").eqNullSafe("log file sync"))


@query("j15_blocker_object", """SELECT a.sample_id, a.session_id, CASE WHEN b.current_obj IS NULL OR b.current_obj = -1 THEN a.current_obj ELSE b.current_obj END AS contended_obj
  FROM samples a LEFT JOIN samples b ON b.inst_id = a.blocking_inst_id AND b.session_id = a.blocking_session AND b.session_serial = a.blocking_session_serial
    AND b.sample_id = CASE WHEN a.time_waited = 0 THEN a.sample_id - 1 ELSE a.sample_id END WHERE a.event = 'enq: TX - index contention'""")
def _(t):
    return B.blocker_object(t.samples, "enq: TX - index contention").select("sample_id", "session_id", "contended_obj")


NEAREST = """SELECT a.sample_id, a.session_id, CASE WHEN b.obj IS NULL OR b.obj = -1 THEN a.current_obj ELSE b.obj END AS contended_obj FROM {s} a LEFT JOIN LATERAL
  (SELECT current_obj AS obj FROM {s} b WHERE b.inst_id = a.blocking_inst_id AND b.session_id = a.blocking_session AND b.session_serial = a.blocking_session_serial
     AND b.sample_id <= a.sample_id - (CASE WHEN a.time_waited = 0 THEN 1 ELSE 0 END) AND b.sample_id > a.sample_id - (CASE WHEN a.time_waited = 0 THEN 1 ELSE 0 END) - {reach}
   ORDER BY b.sample_id DESC LIMIT 1) b ON true WHERE a.event = 'enq: TX - index contention'"""


@query("j15_nearest_holder", NEAREST.format(s="samples", reach=30))
def _(t):
    return B.blocker_object_nearest(t.samples, "enq: TX - index contention", 30).select("sample_id", "session_id", "contended_obj")


@query("j15_nearest_holder_in_archive", NEAREST.format(s="(SELECT * FROM samples WHERE sample_id % 10 = 0)", reach=100))
def _(t):
    """Archived samples: ids ten apart, where the sample before never has the id before."""
    archive = t.samples.where("sample_id % 10 = 0")
    return B.blocker_object_nearest(archive, "enq: TX - index contention", 100).select("sample_id", "session_id", "contended_obj")


@query("j16_held_by", """SELECT s.sample_id, s.session_id, s.event, h.blocked_sessions FROM samples s JOIN
  (SELECT blocking_inst_id, blocking_session, blocking_session_serial, sample_id, count(*) AS blocked_sessions FROM samples
   WHERE blocking_session IS NOT NULL AND event IN ('library cache lock', 'latch free') GROUP BY ALL) h
  ON s.inst_id = h.blocking_inst_id AND s.session_id = h.blocking_session AND s.session_serial = h.blocking_session_serial AND s.sample_id = h.sample_id""")
def _(t):
    return B.held_by(t.samples, ["library cache lock", "latch free"]).select("sample_id", "session_id", "event", "blocked_sessions")


def _climb(cond, label):
    """Recursive walk from matching sessions to the end of their blocker chains."""
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT *, {label} AS label FROM samples WHERE sample_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'),
    walk AS (
      SELECT sample_id, session_id AS start_id, inst_id, session_id, blocking_inst_id, blocking_session, blocking_session_serial, [session_id] AS seen, ' -> ' || label AS chain, 1 AS lvl
      FROM d WHERE {cond}
      UNION ALL
      SELECT w.sample_id, w.start_id, d.inst_id, d.session_id, d.blocking_inst_id, d.blocking_session, d.blocking_session_serial, list_append(w.seen, d.session_id), w.chain || ' -> ' || d.label, w.lvl + 1
      FROM walk w JOIN d ON d.sample_id = w.sample_id AND d.inst_id = w.blocking_inst_id AND d.session_id = w.blocking_session AND NOT list_contains(w.seen, d.session_id)),
    ends AS (SELECT w.*, row_number() OVER (PARTITION BY sample_id, start_id ORDER BY lvl DESC) AS from_end FROM walk w)"""


EVENT_LABEL = "coalesce(event, 'ON CPU') || ' '"
CHAIN_LABEL = f"{PROGRAM_LABEL} || {EVENT_LABEL}"


def _chain_report(weight, tail):
    return f"""SELECT lpad(CAST(CAST((200 * cnt + total) // (2 * total) AS BIGINT) AS VARCHAR) || '%', 5, ' ') AS share, cnt * {weight} AS seconds,
        {rounded(f'cnt * {weight}', '1296000', 1)} AS aas, wait_chain FROM (
      SELECT *, CAST(sum(cnt) OVER () AS BIGINT) AS total FROM (
        SELECT chain{tail} AS wait_chain, count(*) AS cnt FROM ends e LEFT JOIN sessions l ON l.inst_id = e.blocking_inst_id AND l.sid = e.blocking_session AND l.serial = e.blocking_session_serial
        WHERE from_end = 1 GROUP BY 1) c) r ORDER BY cnt DESC, wait_chain LIMIT 30"""


IDLE = " || CASE WHEN blocking_session IS NULL THEN '' ELSE ' -> [idle blocker ' || e.blocking_inst_id || ',' || e.blocking_session || ',' || e.blocking_session_serial || coalesce(' (' || l.program || ')', '') || ']' END"


def _label():
    return glue(text.program_label("program", "session_type"), F.coalesce("event", F.lit("ON CPU")), F.lit(" "))


@query("j17_blocker_paths", f"{_climb('session_id IS NOT NULL', EVENT_LABEL)} SELECT sample_id, start_id AS session_id, lvl AS length, chain FROM ends WHERE from_end = 1")
def _(t):
    rows = t.samples.where(F.col("sample_time").between(START, END))
    label = F.concat(F.coalesce("event", F.lit("ON CPU")), F.lit(" "))
    full = B.sampled_paths(rows, label)
    return full.select(F.col("at").alias("sample_id"), F.col("node.sid").alias("session_id"), F.size("path").alias("length"),
                       F.concat(F.lit(" -> "), F.array_join("labels", " -> ")).alias("chain"))


IDLE_NAMES = """ || CASE WHEN blocking_session IS NULL THEN '' ELSE ' -> [idle blocker ' || e.blocking_inst_id || ',' || e.blocking_session || ',' || e.blocking_session_serial || ']' END"""
_WAITS = "session_state = 'WAITING'"


@query("j18_idle_blockers", f"{_climb(_WAITS, chr(39) + chr(39))} {_chain_report(1, IDLE_NAMES)}")
def _(t):
    return B.wait_chains(t.samples, F.col("session_state") == "WAITING", F.lit(""), START, END)


@query("r09_wait_chain_signatures", f"{_climb(_WAITS, CHAIN_LABEL)} {_chain_report(1, IDLE)}")
def _(t):
    return B.wait_chains(t.samples, F.col("session_state") == "WAITING", _label(), START, END, sessions=t.sessions)


@query("r09_wait_chain_signatures_archive", f"{_climb(_WAITS, CHAIN_LABEL)} {_chain_report(10, '')}")
def _(t):
    return B.wait_chains(t.samples, F.col("session_state") == "WAITING", _label(), START, END, weight=10, idle_blocker=False)


HANG = """WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM samples WHERE sample_id IN (SELECT sample_id FROM samples WHERE hangchain_info = 'Y')),
  tree AS (SELECT sample_id, session_id AS root_session, inst_id, session_id, session_serial, [session_id] AS seen, 1 AS level FROM s
    UNION ALL SELECT p.sample_id, p.root_session, c.inst_id, c.session_id, c.session_serial, list_append(p.seen, c.session_id), p.level + 1
    FROM tree p JOIN s c ON c.sample_id = p.sample_id AND c.blocking_session = p.session_id AND c.blocking_session_serial = p.session_serial AND c.blocking_inst_id = p.inst_id
      AND NOT list_contains(p.seen, c.session_id))
  SELECT t.sample_id, t.root_session, t.level, t.session_id, CASE WHEN EXISTS (SELECT 1 FROM s c WHERE c.sample_id = t.sample_id AND c.blocking_session = t.session_id
      AND list_contains(t.seen, c.session_id)) THEN 'YES' ELSE 'NO' END AS in_cycle, coalesce(a.event, 'Not in wait.') AS wait_event, a.time_waited, q.sql_text
  FROM tree t JOIN s a ON a.sample_id = t.sample_id AND a.session_id = t.session_id LEFT JOIN statements q ON q.sql_id = a.sql_id"""
HANG_COLS = ["sample_id", "root_session", "level", "session_id", "in_cycle", "wait_event", "time_waited", "sql_text"]


@query("j19_hang_tree", HANG)
def _(t):
    return B.hang_tree(t.samples, t.statements).select(*HANG_COLS)


@query("r10_hang_tree_from_true_roots", f"SELECT h.* FROM ({HANG}) h JOIN samples r ON r.sample_id = h.sample_id AND r.session_id = h.root_session WHERE r.blocking_session IS NULL")
def _(t):
    return B.hang_tree(t.samples, t.statements, true_roots=True).select(*HANG_COLS)


@query("r10_blockers_of_hangs", """SELECT s.sample_time, s.session_id, s.event, s.program, h.blocked_sessions FROM samples s JOIN
  (SELECT blocking_inst_id, blocking_session, blocking_session_serial, sample_id, count(*) AS blocked_sessions FROM samples
   WHERE blocking_session IS NOT NULL AND event IN ('library cache lock', 'library cache: mutex X') GROUP BY ALL) h
  ON s.inst_id = h.blocking_inst_id AND s.session_id = h.blocking_session AND s.session_serial = h.blocking_session_serial AND s.sample_id = h.sample_id""")
def _(t):
    return B.held_by(t.samples, ["library cache lock", "library cache: mutex X"]) \
        .select("sample_time", "session_id", "event", "program", "blocked_sessions").orderBy(F.col("blocked_sessions").desc(), "sample_time", "session_id")


NAME = """CASE WHEN o.object_type IS NULL THEN 'Unknown' ELSE o.object_type || ': ' || o.owner || '.' || o.object_name || coalesce(' (' || o.subobject_name || ')', '') END
  || coalesce(' on the ' || i.table_owner || '.' || i.table_name || ' table', '') || ' (object_id: ' || coalesce(CAST(a.current_obj AS VARCHAR), '') || ')'"""
NAMED = "LEFT JOIN objects o ON o.object_id = a.current_obj LEFT JOIN indexes i ON i.owner = o.owner AND i.index_name = o.object_name"
RECENT = "sample_time > TIMESTAMP '2024-01-20 00:00:00'"


@query("r23_contention_simple", f"""SELECT samples, {NAME} AS index_name FROM (SELECT current_obj, count(*) AS samples FROM samples
  WHERE event = 'enq: TX - index contention' AND {RECENT} GROUP BY 1) a {NAMED}""")
def _(t):
    return B.contention_simple(t.samples.where(RECENT), "enq: TX - index contention", t.objects, t.indexes)


CONTENTION = f"""SELECT contended_obj AS current_obj, CAST(sum(cnt) AS BIGINT) AS sessions_sum, count(*) AS sample_times, max(mean_us) AS max_us, avg(mean_us) AS avg_us,
    CASE WHEN max(mean_us) > 5000000 THEN 10 ELSE 1 END AS factor FROM (
  SELECT CASE WHEN b.current_obj IS NULL OR b.current_obj = -1 THEN a.current_obj ELSE b.current_obj END AS contended_obj, a.sample_time, count(*) AS cnt, avg(nullif(a.time_waited, 0)) AS mean_us
  FROM samples a LEFT JOIN samples b ON b.inst_id = a.blocking_inst_id AND b.session_id = a.blocking_session AND b.session_serial = a.blocking_session_serial
    AND b.sample_id = CASE WHEN a.time_waited = 0 THEN a.sample_id - 1 ELSE a.sample_id END
  WHERE a.event = 'enq: TX - index contention' GROUP BY 1, 2) p GROUP BY 1"""


@query("a30_contention_by_object", CONTENTION)
def _(t):
    return B.contention_by_object(B.blocker_object(t.samples, "enq: TX - index contention")).withColumnRenamed("contended_obj", "current_obj")


@query("a30_contention_recent_waits", CONTENTION.replace("GROUP BY 1, 2)", f"AND a.{RECENT} GROUP BY 1, 2)"))
def _(t):
    recent = B.blocker_object(t.samples, "enq: TX - index contention", waits=F.expr(RECENT))  # holders may lie before the window
    return B.contention_by_object(recent).withColumnRenamed("contended_obj", "current_obj")


@query("r23_contention_metric", f"""SELECT {rounded('sessions_sum * factor', 'sample_times')} AS samples, {NAME} AS index_name, round(avg_us / 1e6, 1) AS avg_wait_sec,
    CASE WHEN avg_us * 2 < max_us THEN round(max_us / 1e6, 1) END AS max_wait_sec, {rounded('sessions_sum', 'sample_times')} AS avg_sessions
  FROM ({CONTENTION}) a {NAMED}
  WHERE (sessions_sum * factor / sample_times > 10 OR avg_us > 500000 OR max_us > 1000000) AND (i.index_name IS NULL OR i.index_name <> 'OBJ8')
  ORDER BY sessions_sum * factor / sample_times DESC, index_name LIMIT 3""")
def _(t):
    return B.contention_metric(t.samples, "enq: TX - index contention", t.objects, t.indexes, exclude=["OBJ8"])
