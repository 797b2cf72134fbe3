"""Chains and trees on random graphs against a plain walk."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fleetscope.operators import blocking as B

SCHEMA = """sample_id long, sample_time timestamp_ntz, inst_id long, session_id long, session_serial long, event string, session_state string,
  blocking_inst_id long, blocking_session long, blocking_session_serial long, hangchain_info string, time_waited long, session_type string,
  sql_id string, seq_no long, current_obj long, program string"""
T0 = dt.datetime(2024, 1, 1)


def sample(at, sid, blocker=None, event="w", flag="N", waited=1, obj=None, sql="q"):
    t = T0 + dt.timedelta(seconds=at)
    return (at, t, 1, sid, sid * 10, event, "WAITING" if event else "ON CPU", blocker and 1, blocker, blocker and blocker * 10, flag, waited, "USER", sql, 0, obj, "p")


def random_samples(seed):
    rnd = random.Random(seed)
    out = []
    for at in range(6):
        n = rnd.randint(1, 14)
        for sid in range(1, n + 1):
            # 0 = not blocked; n+1, n+2 = blockers that were not sampled; self loops and cycles happen
            b = rnd.choice([0, *range(1, n + 3)])
            out.append(sample(at, sid, b or None, event=rnd.choice(["a", "b"]), flag=rnd.choice("YNN")))
    return out


def walk(by_id, at, sid):
    """Sessions on the way up from sid, the next blocker, and how it ends."""
    path = [sid]
    while True:
        nxt = by_id[at, path[-1]][8]
        if nxt is None:
            return path, None, "leaf"
        if (at, nxt) not in by_id:
            return path, nxt, "idle"
        if nxt in path:
            return path, nxt, "cycle"
        path.append(nxt)


@pytest.mark.parametrize("seed", range(6))
def test_paths_match_plain_walk(spark, seed):
    data = random_samples(seed)
    by_id = {(r[0], r[3]): r for r in data}
    s = spark.createDataFrame(data, SCHEMA)
    full = B.session_paths(s, F.col("event"), B.blocker_paths(s, F.col("event")))
    got = {(r["at"], r["node"]["sid"]): ([n["sid"] for n in r["path"]], r["next"] and r["next"]["sid"], r["end"], list(r["labels"])) for r in full.collect()}
    want = {k: (*walk(by_id, *k), [by_id[k[0], x][5] for x in walk(by_id, *k)[0]]) for k in by_id}
    assert got == want


def test_long_chain_and_long_cycle(spark):
    data = [sample(1, i, i + 1 if i < 40 else None) for i in range(1, 41)] + [sample(2, i, i % 33 + 1) for i in range(1, 34)]
    s = spark.createDataFrame(data, SCHEMA)
    full = B.session_paths(s, F.col("event"), B.blocker_paths(s, F.col("event")))
    got = {(r["at"], r["node"]["sid"]): (r["n"], r["end"]) for r in full.withColumn("n", F.size("path")).collect()}
    assert got[1, 1] == (40, "leaf") and got[1, 40] == (1, "leaf")
    assert all(got[2, i] == (33, "cycle") for i in range(1, 34))


@pytest.mark.parametrize("seed", range(3))
def test_hang_tree_matches_plain_walk(spark, seed):
    data = random_samples(seed + 50)
    by_id = {(r[0], r[3]): r for r in data}
    flagged = {r[0] for r in data if r[10] == "Y"}
    want = []

    def down(at, root, sid, path):
        kids = [c for (a, c), r in by_id.items() if a == at and r[8] == sid]
        want.append((at, root, len(path), sid, "YES" if any(c in path for c in kids) else "NO"))
        for c in kids:
            if c not in path:
                down(at, root, c, [*path, c])

    for at, sid in by_id:
        if at in flagged:
            down(at, sid, sid, [sid])
    got = rows(B.hang_tree(spark.createDataFrame(data, SCHEMA)), "sample_id", "root_session", "level", "session_id", "in_cycle")
    assert got == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_wait_chain_report(spark):
    s = spark.createDataFrame([sample(1, 1, 2, "a"), sample(1, 2, 3, "b"), sample(1, 3, None, None), sample(1, 4, 99, "a"), sample(2, 1, 2, "a"), sample(2, 2, 1, "b")], SCHEMA)
    sessions = spark.createDataFrame([(1, 99, 990, "ghost")], "inst_id int, sid long, serial long, program string")
    label = F.coalesce("event", F.lit("ON CPU"))
    out = B.wait_chains(s, F.col("event") == "a", label, "2024-01-01 00:00:00", "2024-01-01 00:01:40", sessions=sessions)
    got = rows(out, "wait_chain", "seconds", "share")
    assert got == [
        (" -> a -> [idle blocker 1,99,990 (ghost)]", 1, "  33%"),
        (" -> a -> b -> ON CPU", 1, "  33%"),
        (" -> a -> b -> [idle blocker 1,1,10]", 1, "  33%"),  # the cycle stops before it repeats
    ]


def test_open_wait_uses_previous_sample_of_blocker(spark):
    s = spark.createDataFrame([sample(4, 2, None, None, obj=70), sample(5, 1, 2, "enq", waited=0, obj=5), sample(5, 2, None, None, obj=80), sample(5, 3, 2, "enq", waited=9, obj=5),
                               sample(5, 6, 7, "enq", waited=9, obj=6), sample(5, 7, None, None, obj=-1)], SCHEMA)
    assert rows(B.blocker_object(s, "enq"), "session_id", "contended_obj") == [(1, 70), (3, 80), (6, 6)]


def test_long_wait_multiplies_the_metric(spark):
    s = spark.createDataFrame([sample(1, i, None, "enq", waited=6_000_000 if i == 1 else 0, obj=3) for i in range(1, 4)], SCHEMA)
    r = B.contention_by_object(B.blocker_object(s, "enq")).first()
    assert (r["sessions_sum"], r["sample_times"], r["factor"]) == (3, 1, 10)


def test_holders_on_two_nodes(spark):
    """Waiters of both nodes on one holder; the other node has a session of the same id."""
    cols = "inst_id long, session_id long, session_serial long, sample_id long, event string, time_waited long, current_obj long, blocking_inst_id long, blocking_session long, blocking_session_serial long"
    e = "enq: TX - index contention"
    s = spark.createDataFrame([
        (1, 10, 1, 4, None, 0, 9, None, None, None), (1, 10, 1, 5, None, 0, 9, None, None, None), (2, 10, 1, 5, None, 0, 77, None, None, None),
        (1, 20, 1, 5, e, 8, 3, 1, 10, 1), (2, 30, 1, 5, e, 0, 4, 1, 10, 1)], cols)
    held = B.held_by(s, [e]).select("inst_id", "session_id", "sample_id", "blocked_sessions").collect()
    assert [tuple(r) for r in held] == [(1, 10, 5, 2)]
    got = B.blocker_object(s, e, waits=F.col("sample_id") >= 5).select("session_id", "contended_obj").collect()
    assert sorted(tuple(r) for r in got) == [(20, 9), (30, 9)]


def test_nearest_holder_against_a_plain_walk(spark):
    """Archived samples ten ids apart, with ids on the borders of ranges, open waits, and holders that are too far back."""
    import random

    r = random.Random(4)
    names = "sample_id long, inst_id long, session_id long, session_serial long, event string, blocking_inst_id long, blocking_session long, blocking_session_serial long, time_waited long, current_obj long"
    data = []
    for at in range(0, 600, 10):
        for sid in range(5):
            if r.random() < 0.5:
                data.append((at, 1, sid, 1, r.choice(["W", "W", None]), *r.choice([(1, r.randrange(6), 1), (None, None, None)]), r.choice([0, 5]), r.choice([-1, None, at * 10 + sid])))
    got = B.blocker_object_nearest(spark.createDataFrame(data, names), "W", 40).collect()
    want = []
    for d in (d for d in data if d[4] == "W"):
        at = d[0] - (d[8] == 0)
        held = [h for h in data if h[1:4] == d[5:8] and at - 40 < h[0] <= at]
        obj = max(held)[9] if held and d[6] is not None else None
        want.append((d[0], d[2], d[9] if obj in (None, -1) else obj))
    key = lambda t: tuple(map(str, t))
    assert sorted(((x["sample_id"], x["session_id"], x["contended_obj"]) for x in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("seed", range(3))
def test_trees_below_true_roots_and_paths_of_all(spark, seed):
    data = random_samples(seed + 80)
    by_id = {(r[0], r[3]): r for r in data}
    s = spark.createDataFrame(data, SCHEMA)
    cols = ["sample_id", "root_session", "level", "session_id", "in_cycle"]
    tree = B.hang_tree(s)
    free = s.where("blocking_session IS NULL").select("sample_id", F.col("session_id").alias("root_session"))
    assert rows(B.hang_tree(s, true_roots=True), *cols) == rows(tree.join(free, ["sample_id", "root_session"], "left_semi"), *cols)
    got = {(r["at"], r["node"]["sid"]): ([n["sid"] for n in r["path"]], list(r["labels"])) for r in B.sampled_paths(s, F.col("event")).collect()}
    assert got == {k: (walk(by_id, *k)[0], [by_id[k[0], x][5] for x in walk(by_id, *k)[0]]) for k in by_id}


def test_rings_cost_no_rounds(spark):
    """Pairs that wait for each other, sessions that wait for themselves and short ways to both: the levels end with the longest way."""
    data = [x for i in range(1, 40, 4) for x in (sample(1, i, i + 1), sample(1, i + 1, i), sample(1, i + 2, i), sample(1, i + 3, i + 2))]
    data += [sample(2, 1, 1), sample(2, 2, 1), sample(2, 3, 2)]
    w = B.walks(B._nodes(spark.createDataFrame(data, SCHEMA), F.col("event")))
    assert len(w.levels) == 2 and w.limits is None
    got = {(r["at"], r["id"]["sid"]): (r["n"], r["end"], r["next"]["sid"]) for r in B.ends(w).collect()}
    assert got[1, 1] == (2, "cycle", 1) and got[1, 2] == (2, "cycle", 2) and got[1, 3] == (3, "cycle", 1)
    assert got[2, 1] == (1, "cycle", 1) and got[2, 2] == (2, "cycle", 1)
