"""Who blocks whom.

Within a sample every session waits for at most one other session, so each session has exactly one
path of blockers. Only sessions that block somebody can appear inside such a path; their paths are
walked first, on that small set, by doubling: level k knows the session 2^k steps ahead, and is made of
level k - 1 alone, so the longest chain needs log2(length) rounds. Rounds join sessions and numbers, never
paths. Waiters then need a single join. A path stops at a session without blocker, at a blocker that was
not sampled, or before the first session it already contains. Two sessions that wait for each other are told by the first join
and end the levels; longer cycles are told by the levels, from distances.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.nulls import asc, glue, nz
from ..functions.numbers import ratio, share
from ..functions.times import ts
from ..session import checkpoint
from .topn import top_k


def blocking_levels(s: DataFrame, levels: int = 3, carry: tuple[str, ...] = ("sql_id", "event"),
                    where: Column | None = None) -> DataFrame:
    """Every sample row with its blocker, the blocker's blocker, and so on."""
    at = ["sample_time", "inst_id", "session_id", "session_serial"]
    to = ["sample_time", "blocking_inst_id", "blocking_session", "blocking_session_serial"]
    waiting = F.col("blocking_session").isNotNull()
    blockers = s.where(waiting).select(*[F.col(c).alias(a) for c, a in zip(to, at)]).distinct()
    # blockers with their own chain: the self joins run on this small set only
    holder = blockers.join(s.select(*at, *carry, *to[1:]), at)
    chain = holder.select(*at, *[F.col(c).alias(f"b1_{c}") for c in (*at[1:], *carry)], *[F.col(c).alias(f"_n1_{c}") for c in to[1:]])
    for k in range(2, levels + 1):
        step = holder.select(
            F.col("sample_time"), *[F.col(c).alias(f"_n{k - 1}_{b}") for c, b in zip(at[1:], to[1:])],
            *[F.col(c).alias(f"b{k}_{c}") for c in (*at[1:], *carry)],
            *[F.col(c).alias(f"_n{k}_{c}") for c in to[1:]])
        chain = chain.join(step, ["sample_time", *[f"_n{k - 1}_{b}" for b in to[1:]]], "left")
    shown = [f"b{k}_{c}" for k in range(1, levels + 1) for c in (*at[1:], *carry)]
    chain = chain.select(*[F.col(a).alias(c) for a, c in zip(at, to)], *shown)

    rows = s if where is None else s.where(where)
    base = [*at, *carry]
    blocked = rows.where(waiting).join(chain, to, "left").select(*base, *shown)
    # rows without blocker skip the shuffle instead of all meeting under one NULL key
    free = rows.where(~waiting).select(*base)
    return blocked.unionByName(free, allowMissingColumns=True)


def blocker_object(s: DataFrame, event: str, waits: Column | None = None) -> DataFrame:
    """Waits on event with the object of the blocker; an open wait (no time yet) uses the blocker's previous sample.

    waits restricts the waits only, to a trailing window for instance: their holders may lie before it.
    """
    found = s.where(F.col("event") == event)
    if waits is not None:
        found = found.where(waits)
    holder = s.select(
        F.col("inst_id").alias("blocking_inst_id"), F.col("session_id").alias("blocking_session"),
        F.col("session_serial").alias("blocking_session_serial"), F.col("sample_id").alias("_at"), F.col("current_obj").alias("_obj"))
    at = F.when(F.col("time_waited") == 0, F.col("sample_id") - 1).otherwise(F.col("sample_id"))
    keys = ["blocking_inst_id", "blocking_session", "blocking_session_serial", "_at"]
    return (
        found.withColumn("_at", at).join(holder, keys, "left")
        .withColumn("contended_obj", F.when(F.col("_obj").isNull() | (F.col("_obj") == -1), F.col("current_obj")).otherwise(F.col("_obj")))
        .drop("_at", "_obj")
    )


def blocker_object_nearest(s: DataFrame, event: str, reach: int, waits: Column | None = None) -> DataFrame:
    """blocker_object for samples that lie apart, such as archived ones: the holder's latest sample within reach ids.

    A wait that is over looks from its own sample back, an open one from the sample before; `_at` of the two is never met
    exactly in an archive. Ids are cut into ranges of reach, and a holder's sample is carried over into the next range, so
    each wait meets its candidates under one key and no session's samples are seen as a whole. The lookups are distinct
    and the latest sample is an aggregation, so a holder that many sessions wait for is looked up once.
    """
    found = s.where(F.col("event") == event)
    if waits is not None:
        found = found.where(waits)
    who = ["blocking_inst_id", "blocking_session", "blocking_session_serial"]
    found = found.withColumn("_at", F.when(F.col("time_waited") == 0, F.col("sample_id") - 1).otherwise(F.col("sample_id")))
    cut = lambda c: F.floor(F.col(c) / F.lit(reach)).cast("long")
    asked = found.where(F.col("blocking_session").isNotNull()).select(*who, "_at").distinct().withColumn("_range", cut("_at"))
    holder = s.select(F.col("inst_id").alias(who[0]), F.col("session_id").alias(who[1]), F.col("session_serial").alias(who[2]),
                      F.col("sample_id").alias("_held"), F.col("current_obj").alias("_obj"))
    holder = holder.withColumn("_range", F.explode(F.array(cut("_held"), cut("_held") + 1)))
    met = asked.join(holder, [*who, "_range"]).where((F.col("_held") <= F.col("_at")) & (F.col("_held") > F.col("_at") - reach))
    last = met.groupBy(*who, "_at").agg(F.max_by("_obj", "_held").alias("_obj"))
    return (
        found.join(last, [*who, "_at"], "left")
        .withColumn("contended_obj", F.when(F.col("_obj").isNull() | (F.col("_obj") == -1), F.col("current_obj")).otherwise(F.col("_obj")))
        .select(*s.columns, "contended_obj")
    )


def held_by(s: DataFrame, events: list[str]) -> DataFrame:
    """Samples of blockers with the number of sessions, of all instances, that they hold on the given events."""
    held = (
        s.where(F.col("blocking_session").isNotNull() & F.col("event").isin(events))
        .groupBy("blocking_inst_id", "blocking_session", "blocking_session_serial", "sample_id")
        .agg(F.count(F.lit(1)).alias("blocked_sessions"))
        .select(F.col("blocking_inst_id").alias("inst_id"), F.col("blocking_session").alias("session_id"),
                F.col("blocking_session_serial").alias("session_serial"), "sample_id", "blocked_sessions")
    )
    return s.join(held, ["inst_id", "session_id", "session_serial", "sample_id"])


def _node(inst: str, sid: str, serial: str) -> Column:
    return F.when(F.col(sid).isNotNull(), F.struct(F.col(inst).cast("bigint").alias("inst"), F.col(sid).alias("sid"), F.col(serial).alias("serial")))


def _nodes(s: DataFrame, label: Column) -> DataFrame:
    return s.select(
        F.col("sample_id").alias("at"),
        _node("inst_id", "session_id", "session_serial").alias("node"),
        label.alias("label"),
        _node("blocking_inst_id", "blocking_session", "blocking_session_serial").alias("next"),
    )


SID = "struct<inst:bigint,sid:bigint>"
WHOLE = "struct<inst:bigint,sid:bigint,serial:bigint>"
KINDS = {"node": WHOLE, "label": "string"}


def _sid(c: str) -> Column:
    """A session without its serial: what sessions meet by."""
    return F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.inst").cast("bigint").alias("inst"), F.col(f"{c}.sid").cast("bigint").alias("sid")))


# A chain of labels x0, x1, ... has the number x0 + x1*B + x2*B^2 + ... modulo a prime, so the numbers of two pieces
# make that of both. Two such numbers, from different hashes of the labels, stand for a chain.
PRIME = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % PRIME


def _times(a: Column, b: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return (wide(a) * wide(b) % F.lit(PRIME)).cast("bigint")


def _plus(a: Column, b: Column) -> Column:
    return (a + b) % F.lit(PRIME)


def _number(label: str, lane: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(lane), F.coalesce(F.col(label), F.lit(""))), F.lit(PRIME))


LANES = ("h0", "h1")


@dataclass
class Walks:
    """Blockers and the levels to walk by.

    base: at, id, node, label, next of every sampled session that blocks somebody; ring: it waits for itself, or for a session
    that waits for it. Level k: of blockers with 2^k sessions ahead, the session behind these (`to`). Levels stop at rings, so these
    cost no rounds; longer cycles are in limits (at, id, limit: path length, entry: where it closes), None if there are none.
    """

    base: DataFrame
    levels: list[DataFrame]
    limits: DataFrame | None
    numbered: bool


def _beside(id_: str, next_: str, ring: str) -> Column:
    """The other session of a ring of two."""
    return F.when(F.col(ring) & (F.col(id_) != _sid(next_)), _sid(next_))


def _levels(base: DataFrame, numbered: bool) -> tuple[list[DataFrame], list[int], bool]:
    """Levels by doubling, each written once and made of the one before alone; how many sessions each has; and whether there are cycles.

    Rings are ends: more says how many sessions follow there (0 or 1), beside is the one that follows `to`. Without longer cycles
    nobody is left in the end. What is left when two levels in a row reach the same sessions is on cycles or leads to them: such
    a level only permutes the sessions that it reaches.
    """
    lanes = LANES if numbered else ()
    known = base.select("at", F.col("id").alias("to"), F.lit(True).alias("sampled"), _beside("id", "next", "ring").alias("beside"),
                        *[_number("label", i).alias(f"to_{h}") for i, h in enumerate(lanes)])
    first = base.withColumn("to", _sid("next")).join(known, ["at", "to"], "left")
    to, more = F.when(~F.col("ring") & F.col("sampled"), F.col("to")), F.when(F.col("ring"), F.when(F.col("id") == F.col("to"), 0).otherwise(1))
    out = F.when(F.col("ring"), F.col("node")).when(F.col("sampled").isNull(), F.col("next"))
    numbers = [F.when(more == 1, _plus(_number("label", i), _times(F.lit(BASE), F.col(f"to_{h}")))).otherwise(_number("label", i)).alias(h) for i, h in enumerate(lanes)]
    grown = first.select("at", "id", to.alias("to"), F.when(~F.col("ring"), F.col("beside")).alias("beside"), out.alias("out"), more.alias("more"),
                         F.col("id").alias("last"), to.alias("low"), F.lit(True).alias("moved"), *numbers)
    levels, sizes, before = [], [], None
    while True:
        seen = Observation()  # counted while the level is written
        level = checkpoint(grown.observe(seen, F.count(F.lit(1)).alias("n"), F.count("to").alias("open"), F.count_if("moved").alias("moved")))
        levels.append(level)
        sizes.append(seen.get["n"])
        if not seen.get["open"]:
            return levels, sizes, False
        if not seen.get["moved"] and before == seen.get["open"]:
            image = [x.where(F.col("to").isNotNull()).select(F.count_distinct("at", "to")).scalar() for x in levels[-2:]]
            if base.sparkSession.range(1).select((image[0] == image[1]).alias("same")).first()["same"]:
                return levels, sizes, True
        before, step = seen.get["open"], pow(BASE, 1 << (len(levels) - 1), PRIME)
        ahead = level.select("at", F.col("id").alias("to"), F.struct("to", "beside", "out", "more", "last", "low", *lanes).alias("r"))
        low = F.least("low", "r.low")
        grown = level.where(F.col("to").isNotNull()).join(ahead, ["at", "to"]).select(
            "at", "id", *[F.col(f"r.{c}").alias(c) for c in ("to", "beside", "out", "more", "last")], low.alias("low"), (low != F.col("low")).alias("moved"),
            *[_plus(F.col(h), _times(F.lit(step), F.col(f"r.{h}"))).alias(h) for h in lanes])


def _cycle_lengths(base: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """at, id, limit, entry of the sessions that are on a cycle or lead to one: path length, and where the path closes."""
    last = levels[-1].where(F.col("to").isNotNull())
    on = last.select("at", F.col("to").alias("id")).distinct()
    ring = last.join(on, ["at", "id"])  # sessions of a cycle have its least session in common
    size = ring.groupBy("at", "low").agg(F.count(F.lit(1)).alias("limit"))
    ring = checkpoint(ring.select("at", "id", "low").join(size, ["at", "low"]).join(base.select("at", "id", F.col("node").alias("entry")), ["at", "id"])
                      .select("at", "id", "limit", "entry"))
    outside = checkpoint(last.select("at", "id").join(ring, ["at", "id"], "left_anti"))
    if outside.isEmpty():
        return ring
    # the last session before the cycle: longest step first, steps onto the cycle not taken
    walk = outside.select("at", "id", F.col("id").alias("cur"), F.lit(1).cast("bigint").alias("t"))
    for k in reversed(range(len(levels))):
        step = (levels[k].where(F.col("to").isNotNull()).select("at", F.col("id").alias("cur"), "to")
                .join(outside.select("at", F.col("id").alias("to")), ["at", "to"], "left_semi"))
        walk = walk.join(step, ["at", "cur"], "left").select(
            "at", "id", F.coalesce("to", "cur").alias("cur"), (F.col("t") + F.when(F.col("to").isNull(), 0).otherwise(1 << k)).alias("t"))
    door = base.select("at", F.col("id").alias("cur"), _sid("next").alias("door"))
    found = walk.join(door, ["at", "cur"]).join(ring.withColumnRenamed("id", "door"), ["at", "door"])
    return ring.unionByName(found.select("at", "id", (F.col("t") + F.col("limit")).alias("limit"), "entry"))


def walks(nodes: DataFrame, numbered: bool = False) -> Walks:
    """Walks of the blockers among nodes (at, node, label, next). Nothing but sessions and numbers is joined in the rounds.

    numbered: levels also have the numbers of their label chains.
    """
    nodes = nodes.withColumn("id", _sid("node"))
    waits = nodes.where(F.col("next").isNotNull()).select("at", _sid("next").alias("id"), F.col("id").alias("waiter"))
    base = checkpoint(nodes.join(waits, ["at", "id"]).groupBy("at", "id", "node", "label", "next").agg(
        F.coalesce(F.bool_or(F.col("waiter") == _sid("next")), F.lit(False)).alias("ring")))
    levels, sizes, cycles = _levels(base, numbered)
    if not cycles:
        return Walks(base, levels, None, numbered)
    limits = checkpoint(_cycle_lengths(base, levels))
    longest = limits.agg(F.max("limit")).first()[0]
    # a level with no more sessions than the last one has those of cycles alone, and is of no use if they are shorter
    return Walks(base, [x for k, x in enumerate(levels) if sizes[k] > sizes[-1] or 1 << k <= longest], limits, numbered)


def ends(w: Walks) -> DataFrame:
    """Where each blocker's path goes and how it ends: at, id, n (sessions on the path, itself included), next (NULL for a true
    end), end ('leaf', 'idle': blocker not sampled, 'cycle': next is on the path), last (NULL in longer cycles) and the path's numbers."""
    lanes = LANES if w.numbered else ()
    go = w.base.select("at", "id")
    if w.limits is not None:
        go = go.join(w.limits, ["at", "id"], "left")
    else:
        go = go.select("*", F.lit(None).cast("bigint").alias("limit"), F.lit(None).cast(WHOLE).alias("entry"))
    zero = F.lit(0).cast("bigint")
    go = go.select("*", F.col("id").alias("cur"), zero.alias("n"), F.lit(None).cast(WHOLE).alias("out"), F.lit(None).cast("int").alias("more"),
                   F.lit(None).cast(SID).alias("last"), *([F.lit(1).cast("bigint").alias("scale")] if lanes else []), *[zero.alias(h) for h in lanes])
    for k in reversed(range(len(w.levels))):
        step = w.levels[k].select(F.col("at").alias("_at"), F.col("id").alias("_id"), F.struct("to", "out", "more", "last", *lanes).alias("r"))
        fits = F.col("limit").isNull() | (F.col("n") + (1 << k) <= F.col("limit"))
        went = F.col("r").isNotNull()
        scale = [F.when(went, _times(F.col("scale"), F.lit(pow(BASE, 1 << k, PRIME)))).otherwise(F.col("scale")).alias("scale")] if lanes else []
        go = go.join(step, (F.col("at") == F.col("_at")) & (F.col("cur") == F.col("_id")) & fits, "left").select(
            "at", "id", "limit", "entry", F.when(went, F.col("r.to")).otherwise(F.col("cur")).alias("cur"),
            F.when(went, F.col("n") + (1 << k)).otherwise(F.col("n")).alias("n"),
            *[F.when(went, F.col(f"r.{c}")).otherwise(F.col(c)).alias(c) for c in ("out", "more", "last")], *scale,
            *[F.when(went, _plus(F.col(h), _times(F.col("scale"), F.col(f"r.{h}")))).otherwise(F.col(h)).alias(h) for h in lanes])
    closed = F.col("limit").isNotNull()
    return go.select(
        "at", "id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.when(closed, F.col("entry")).otherwise(F.col("out")).alias("next"),
        F.when(closed | F.col("more").isNotNull(), "cycle").when(F.col("out").isNull(), "leaf").otherwise("idle").alias("end"),
        F.when(~closed, F.col("last")).alias("last"), *lanes)


def ancestors(w: Walks, start: DataFrame | None = None) -> DataFrame:
    """at, id, dist, above: every session on the path of the given blockers (all by default), itself at distance 0; closes: the session
    waits for id itself.

    start: at and id, once each. A step of each level is taken or not, so each distance below the path's length comes once.
    """
    one = F.when(F.col("ring"), F.when(F.col("id") == _sid("next"), 0).otherwise(1)).cast("bigint")
    go = w.base.select("at", "id", one.alias("turn"), _beside("id", "next", "ring").alias("beside"))
    if start is not None:
        go = go.join(start.select("at", "id"), ["at", "id"], "left_semi")
    limit = []
    if w.limits is not None:
        go, limit = go.join(w.limits, ["at", "id"], "left"), ["limit"]
        go = go.withColumn("turn", F.coalesce("turn", F.when(_sid("entry") == F.col("id"), F.col("limit") - 1)))
    go = go.select("at", "id", *limit, "turn", F.col("id").alias("above"), "beside", F.lit(0).cast("bigint").alias("dist"))
    stay = F.struct("above", "beside", "dist")
    for k, level in enumerate(w.levels):
        step = level.where(F.col("to").isNotNull()).select(F.col("at").alias("_at"), F.col("id").alias("_id"), "to", F.col("beside").alias("to_beside"))
        on = (F.col("at") == F.col("_at")) & (F.col("above") == F.col("_id"))
        if limit:
            on = on & (F.col("limit").isNull() | (F.col("dist") + (1 << k) < F.col("limit")))
        moved = F.struct(F.col("to").alias("above"), F.col("to_beside").alias("beside"), (F.col("dist") + (1 << k)).alias("dist"))
        go = go.join(step, on, "left").select("at", "id", *limit, "turn", F.explode(F.when(F.col("to").isNull(), F.array(stay)).otherwise(F.array(stay, moved))).alias("g"))
        go = go.select("at", "id", *limit, "turn", "g.above", "g.beside", "g.dist")
    here = F.struct("above", "dist")
    both = F.when(F.col("beside").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("beside").alias("above"), (F.col("dist") + 1).alias("dist"))))
    return go.select("at", "id", "turn", F.explode(both).alias("g")).select(
        "at", "id", "g.above", "g.dist", F.coalesce(F.col("g.dist") == F.col("turn"), F.lit(False)).alias("closes"))


def _with_paths(w: Walks, start: DataFrame | None = None) -> DataFrame:
    """at, id, path, labels, next and end of the given blockers: whole paths, put together in one aggregation."""
    on = w.base.select("at", F.col("id").alias("above"), F.struct("node", "label", "next").alias("x"))
    steps = ancestors(w, start).join(on, ["at", "above"]).groupBy("at", "id").agg(
        F.sort_array(F.collect_list(F.struct("dist", "x.node", "x.label"))).alias("s"), F.max_by("x.next", "dist").alias("next"))
    steps = steps.select("at", "id", F.col("s.node").alias("path"), F.col("s.label").alias("labels"), "next")
    sids = F.transform("path", lambda x: F.struct(x["inst"].alias("inst"), x["sid"].alias("sid")))
    return steps.withColumn("end", F.when(F.col("next").isNull(), "leaf").when(F.array_contains(sids, _sid("next")), "cycle").otherwise("idle"))


def blocker_paths(s: DataFrame, label: Column) -> DataFrame:
    """Path of blockers of every sampled session that blocks somebody.

    Columns: at, node, path (from the session itself), labels along it, next (the blocker the last
    session waits for, NULL for a true end) and end: 'leaf', 'idle' (blocker not sampled) or 'cycle'.
    """
    w = walks(_nodes(s, label))
    return (_with_paths(w).join(w.base.select("at", "id", "node"), ["at", "id"])
            .select("at", "node", "path", "labels", "next", "end"))


def sampled_paths(s: DataFrame, label: Column) -> DataFrame:
    """at, node, path and labels of every given session: session_paths over blocker_paths, with the samples read once and each path looked up once."""
    rows = checkpoint(_nodes(s, label))
    w = walks(rows)
    own = rows.withColumn("id", _sid("node")).join(w.base.select("at", "id", F.lit(True).alias("is_blocker")), ["at", "id"], "left")
    blocks = F.col("is_blocker").isNotNull()
    asks = own.select("at", "node", "label", blocks.alias("blocks"), F.when(blocks, F.col("id")).otherwise(_sid("next")).alias("start"))
    mine = lambda c: F.when(F.col("blocks"), F.array().cast(f"array<{KINDS[c]}>")).otherwise(F.array(c))
    alone = asks.where(F.col("start").isNull()).select("at", "node", F.array("node").alias("path"), F.array("label").alias("labels"))
    met = asks.where(F.col("start").isNotNull()).join(_with_paths(w).select("at", F.col("id").alias("start"), "path", "labels"), ["at", "start"], "left")
    return alone.unionByName(met.select("at", "node", F.concat(mine("node"), F.coalesce("path", F.array().cast(f"array<{WHOLE}>"))).alias("path"),
                                        F.concat(mine("label"), F.coalesce("labels", F.array().cast("array<string>"))).alias("labels")))


def session_paths(s: DataFrame, label: Column, paths: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Full blocker path of every given session; blockers already have theirs in paths."""
    mine = s.select(
        F.col("sample_id").alias("at"), _node("inst_id", "session_id", "session_serial").alias("node"), label.alias("label"),
        _node("blocking_inst_id", "blocking_session", "blocking_session_serial").alias("next"), *keep)
    known = paths.select("at", _sid("node").alias("id"), F.struct("path", "labels", "next", "end").alias("r"))
    own = mine.withColumn("id", _sid("node")).join(known, ["at", "id"], "left").drop("id")
    blockers = own.where(F.col("r").isNotNull()).select(*keep, "at", "node", "r.path", "r.labels", "r.next", "r.end")
    others = own.where(F.col("r").isNull()).drop("r")
    alone = others.where(F.col("next").isNull()).select(
        *keep, "at", "node", F.array("node").alias("path"), F.array("label").alias("labels"), "next", F.lit("leaf").alias("end"))
    # a session that blocks nobody cannot occur in its blocker's path, so the path is simply prefixed
    waiting = (others.where(F.col("next").isNotNull()).withColumn("id", _sid("next"))
               .join(known, ["at", "id"], "left")
               .select(*keep, "at", "node",
                       F.concat(F.array("node"), F.coalesce("r.path", F.array().cast(f"array<{WHOLE}>"))).alias("path"),
                       F.concat(F.array("label"), F.coalesce("r.labels", F.array().cast("array<string>"))).alias("labels"),
                       F.when(F.col("r").isNull(), F.col("next")).otherwise(F.col("r.next")).alias("next"),
                       F.coalesce("r.end", F.lit("idle")).alias("end")))
    return blockers.unionByName(alone).unionByName(waiting)


def wait_chains(s: DataFrame, start: Column, label: Column, begin: str, end: str, weight: int = 1, k: int = 30,
                sessions: DataFrame | None = None, idle_blocker: bool = True) -> DataFrame:
    """Signatures of blocker chains from the sessions that meet start, with seconds, share and AAS.

    start restricts only where chains begin, never the blockers on the way. With idle_blocker a
    chain whose last session still waits names that blocker. Chains are counted by their numbers; texts are
    put together for the chains that can be among the k most frequent (more than k only where counts are equal).
    """
    rows = s.where(F.col("sample_time").between(ts(begin), ts(end)))
    nodes = checkpoint(rows.select(
        F.col("sample_id").alias("at"), _node("inst_id", "session_id", "session_serial").alias("node"), F.coalesce(label, F.lit("")).alias("label"),
        _node("blocking_inst_id", "blocking_session", "blocking_session_serial").alias("next"), F.coalesce(start, F.lit(False)).alias("starts")))
    w = walks(nodes.drop("starts"), numbered=True)
    found = checkpoint(ends(w).select("at", "id", "n", F.col("next").alias("last"), *LANES))
    blockers = w.base.select("at", "id", F.lit(True).alias("is_blocker"))
    first = nodes.where("starts").withColumn("id", _sid("node")).join(blockers, ["at", "id"], "left")
    # sessions that block nobody differ only by label and blocker: count them before the join
    plain = (first.where(F.col("is_blocker").isNull()).groupBy("at", "label", "next").agg(F.count(F.lit(1)).alias("cnt"))
             .withColumn("id", _sid("next")))
    inside = first.where(F.col("is_blocker")).select("at", "id", F.lit(None).cast("string").alias("label"), F.lit(None).cast(WHOLE).alias("next"),
                                                     F.lit(1).cast("bigint").alias("cnt"))
    free = plain.where(F.col("id").isNull()).select("*", *[F.lit(None).alias(c) for c in ("n", "last", *LANES)])
    met = plain.where(F.col("id").isNotNull()).unionByName(inside).join(found, ["at", "id"], "left").unionByName(free)
    own = [F.when(F.col("label").isNull(), F.col(h)).otherwise(
        _plus(_number("label", i), F.when(F.col(h).isNull(), 0).otherwise(_times(F.lit(BASE), F.col(h))))).alias(h) for i, h in enumerate(LANES)]
    length = F.coalesce("n", F.lit(0)) + F.when(F.col("label").isNull(), 0).otherwise(1)
    last = F.when(F.col("n").isNull(), F.col("next")).otherwise(F.col("last")) if idle_blocker else F.lit(None).cast(WHOLE)
    example = F.struct("label", F.when(F.col("n").isNotNull(), F.struct("at", "id", "n")).alias("above"))
    # length is part of the key: labels may be empty
    counted = checkpoint(met.select(*own, length.alias("length"), last.alias("next"), example.alias("example"), "cnt")
                         .groupBy(*LANES, "length", "next").agg(F.sum("cnt").alias("cnt"), F.min("example").alias("example")))
    most = counted.select("cnt").orderBy(F.col("cnt").desc()).limit(k).agg(F.min("cnt").alias("least"))
    total = counted.agg(F.sum("cnt").alias("_total"))
    shown = counted.where(F.col("cnt") >= most.scalar()).select("*", F.col("example.above.at").alias("at"), F.col("example.above.id").alias("id"))
    above = shown.where(F.col("id").isNotNull()).select("at", "id", F.col("example.above.n").alias("n")).distinct()
    texts = _with_paths(w, above).select("at", "id", "labels")
    blank = F.array().cast("array<string>")
    labels = F.concat(F.when(F.col("example.label").isNull(), blank).otherwise(F.array("example.label")), F.coalesce("labels", blank))
    shown = shown.where(F.col("id").isNotNull()).join(texts, ["at", "id"]).unionByName(
        shown.where(F.col("id").isNull()).withColumn("labels", blank))
    shown = shown.withColumn("chain", F.array_join(F.transform(labels, lambda x: F.concat(F.lit(" -> "), x)), ""))
    if idle_blocker:
        shown = shown.withColumns({"inst": F.col("next.inst"), "sid": F.col("next.sid"), "serial": F.col("next.serial")})
        if sessions is not None:
            names = sessions.select(F.col("inst_id").cast("bigint").alias("inst"), "sid", "serial", F.concat(F.lit(" ("), F.col("program"), F.lit(")")).alias("who"))
            shown = shown.join(names, ["inst", "sid", "serial"], "left")
        else:
            shown = shown.withColumn("who", F.lit(None).cast("string"))
        tail = F.when(F.col("sid").isNotNull(), glue(F.lit(" -> [idle blocker "), F.col("inst"), F.lit(","), F.col("sid"), F.lit(","), F.col("serial"), F.col("who"), F.lit("]")))
        shown = shown.withColumn("chain", F.concat_ws("", "chain", tail))
    seconds = F.timestamp_diff("SECOND", ts(begin), ts(end))
    return top_k(shown.select("chain", "cnt", total.scalar().alias("_total")), [F.col("cnt").desc(), asc("chain")], k).select(
        share("cnt", "_total").alias("share"), (F.col("cnt") * weight).alias("seconds"),
        ratio(F.col("cnt") * weight, seconds, 1).alias("aas"), F.col("chain").alias("wait_chain"))


def hang_tree(s: DataFrame, texts: DataFrame | None = None, roots: Column | None = None, text_chars: int | None = None,
              true_roots: bool = False) -> DataFrame:
    """For samples with a hang participant: every session under each of its direct and indirect blockers.

    A row says that session is reached from root at level (1 = the root itself). Without roots all
    sessions are roots, as in the procedural original; in_cycle marks the row whose session blocks
    the root it was reached from. text_chars cuts the statement text for print; whole texts otherwise.
    true_roots: only trees below sessions that wait for nobody; these are ends of paths, so no other blockers are listed.
    """
    flagged = s.where(F.col("hangchain_info") == "Y").select("sample_id").distinct()
    keep = ["sample_time", "event", "time_waited", "session_type", "sql_id", "seq_no"]
    rows = checkpoint(s.join(flagged, "sample_id", "left_semi").select(
        F.col("sample_id").alias("at"), *keep, _node("inst_id", "session_id", "session_serial").alias("node"), F.lit("").alias("label"),
        _node("blocking_inst_id", "blocking_session", "blocking_session_serial").alias("next")))
    w = walks(rows.select("at", "node", "label", "next"))
    # walking up from a session is walking down from each of its blockers, read backwards
    own = rows.withColumn("id", _sid("node")).join(w.base.select("at", "id", F.lit(True).alias("is_blocker")), ["at", "id"], "left")
    other = F.col("is_blocker").isNull()
    alone = own.where(other & F.col("next").isNull() if true_roots else other).select(
        "at", *keep, "node", F.col("id").alias("above"), F.lit(1).cast("bigint").alias("level"), F.lit("NO").alias("in_cycle"))
    asks = own.withColumns({"start": F.when(other, _sid("next")).otherwise(F.col("id")), "shift": F.when(other, 2).otherwise(1)}).drop("id", "next", "label")
    if true_roots:  # one at most: the end of the path
        above = ends(w).where("end = 'leaf'").select("at", F.col("id").alias("start"), F.col("last").alias("above"), (F.col("n") - 1).alias("dist"), F.lit(False).alias("closes"))
        alone = alone.where(F.col("above").isNotNull())
    else:
        above = ancestors(w).withColumnRenamed("id", "start")
    under = asks.where(F.col("start").isNotNull()).join(above, ["at", "start"]).select(
        "at", *keep, "node", "above", (F.col("dist") + F.col("shift")).alias("level"), F.when(F.col("closes") & ~other, "YES").otherwise("NO").alias("in_cycle"))
    out = alone.unionByName(under).select(
        F.col("at").alias("sample_id"), "sample_time", F.col("above.inst").alias("root_inst"), F.col("above.sid").alias("root_session"),
        F.col("level").cast("int").alias("level"), F.col("node.inst").alias("inst_id"), F.col("node.sid").alias("session_id"),
        F.col("node.serial").alias("session_serial"), F.col("seq_no").alias("wait_seq"), "in_cycle",
        F.coalesce("event", F.lit("Not in wait.")).alias("wait_event"), "time_waited", "session_type", "sql_id")
    if roots is not None:
        out = out.where(roots)
    if texts is not None:
        shown = F.col("sql_text") if text_chars is None else F.substring("sql_text", 1, text_chars)
        out = out.join(texts.select("sql_id", shown.alias("sql_text")), "sql_id", "left")
    return out


def contention_simple(s: DataFrame, event: str, objects: DataFrame, indexes: DataFrame) -> DataFrame:
    """Samples on a contention event per object."""
    hits = s.where(F.col("event") == event).groupBy("current_obj").agg(F.count(F.lit(1)).alias("samples"))
    return _named(hits, objects, indexes).select("samples", "index_name").orderBy(F.col("samples").desc(), "index_name")


def _named(df: DataFrame, objects: DataFrame, indexes: DataFrame) -> DataFrame:
    """Readable object name with its type, partition, and for indexes the table."""
    o = objects.select(F.col("object_id").alias("current_obj"), "owner", "object_name", "subobject_name", "object_type")
    i = indexes.select("owner", F.col("index_name").alias("object_name"), "table_owner", "table_name")
    where = F.when(F.col("object_type").isNotNull(), glue(
        F.col("object_type"), F.lit(": "), F.col("owner"), F.lit("."), F.col("object_name"),
        F.when(F.col("subobject_name").isNotNull(), F.concat(F.lit(" ("), F.col("subobject_name"), F.lit(")"))))).otherwise("Unknown")
    on = F.when(F.col("table_owner").isNotNull(), glue(F.lit(" on the "), F.col("table_owner"), F.lit("."), F.col("table_name"), F.lit(" table")))
    return (df.join(o, "current_obj", "left").join(i, ["owner", "object_name"], "left")
            .withColumn("index_name", glue(where, on, F.lit(" (object_id: "), F.col("current_obj"), F.lit(")"))))


# The alert's thresholds, microseconds unless said.
LONG_WAIT_US = 5000000
LONG_WAIT_FACTOR = 10
REPORT_SESSIONS, REPORT_MEAN_US, REPORT_MAX_US = 10, 500000, 1000000
ALERT_SESSIONS = 200


def contention_by_object(waits: DataFrame) -> DataFrame:
    """Contention per object from waits that carry contended_obj: first per sample, then over samples.

    Sums are kept exact: peak is the mean number of sessions per sample, ten times that when a long wait occurred.
    """
    per_sample = waits.groupBy("contended_obj", "sample_time").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.avg(nz("time_waited")).alias("mean_us"))
    return (
        per_sample.groupBy("contended_obj").agg(
            F.sum("cnt").alias("sessions_sum"), F.count(F.lit(1)).alias("sample_times"),
            F.max("mean_us").alias("max_us"), F.avg("mean_us").alias("avg_us"))
        .withColumn("factor", F.when(F.col("max_us") > LONG_WAIT_US, LONG_WAIT_FACTOR).otherwise(1))
    )


def contention_metric(s: DataFrame, event: str, objects: DataFrame, indexes: DataFrame, exclude: list[str] = (), k: int = 3,
                      waits: Column | None = None) -> DataFrame:
    """The k most contended objects, small values left out; waits as in blocker_object."""
    per_object = contention_by_object(blocker_object(s, event, waits)).withColumnRenamed("contended_obj", "current_obj")
    peak = F.col("sessions_sum") * F.col("factor") / F.col("sample_times")
    named = _named(per_object, objects, indexes)
    if exclude:
        named = named.where(F.col("table_name").isNull() | ~F.col("object_name").isin(list(exclude)))
    worth = (peak > REPORT_SESSIONS) | (F.col("avg_us") > REPORT_MEAN_US) | (F.col("max_us") > REPORT_MAX_US)
    shown = named.where(worth).select(
        ratio(F.col("sessions_sum") * F.col("factor"), "sample_times").alias("samples"), "index_name",
        F.round(F.col("avg_us") / 1e6, 1).alias("avg_wait_sec"),
        F.when(F.col("avg_us") * 2 < F.col("max_us"), F.round(F.col("max_us") / 1e6, 1)).alias("max_wait_sec"),
        ratio("sessions_sum", "sample_times").alias("avg_sessions"), peak.alias("peak"))
    return top_k(shown, [F.col("peak").desc(), F.col("index_name")], k).drop("peak")

