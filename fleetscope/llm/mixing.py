"""Mixing sources to target weights by Pfair scheduling (DataFrame and SQL functions only).

A source's rows, in an order given by the hash of their key, form blocks of `block_rows` rows. Time is a sequence
of slots, one block each. With weight w, block i (from 0) of a source is released at slot floor(i / w) and due
before slot ceil((i + 1) / w); in every slot, the released block with the earliest deadline runs. Then, at every
slot t, each source has had more than w * t - 1 and fewer than w * t + 1 blocks.

Release and deadline of every block follow from the weights as given, as exact fractions, so the distance from them does
not grow with the input. The order of the blocks is made on the driver, one step of two heaps a block and none for its
rows, and written to the shared folder in pieces of bounded size; rows get their slots by a join over block numbers.

The mix ends when each source has been used up once. Sources that come to their end earlier start again from
their first block (a new epoch), so no row is lost and the weights hold to the end.

Sources are what weights are given for: one row each comes to the driver, so group hosts or the like.

Null sources are a source of their own; rows with null keys and repeated rows are ordinary rows. Sources without
a weight, or with weight zero, are an error: they could never end. An empty table gives an empty mix.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from .exprs import numbered, shared_folder

BLOCK_ROWS = 16
PERIOD = 1000
#: Exponent put on the sources' shares when no weights are given: below 1 it lifts small sources.
TEMPER = 0.95


def parts_of(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Whole parts of a period, at least one each, nearest to the weights; they add up to the period."""
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights must be positive")
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    order = sorted(weights, key=lambda s: (s is None, s))
    exact = {s: (period - len(order)) * weights[s] / total for s in order}
    parts = {s: 1 + math.floor(x) for s, x in exact.items()}
    left = period - sum(parts.values())
    for s in sorted(order, key=lambda s: math.floor(exact[s]) - exact[s])[:left]:
        parts[s] += 1
    return parts


def turns(weights: Mapping[str | None, float], blocks: Mapping[str | None, int]) -> Iterator[str | None]:
    """The source of each slot, until each source had all of its blocks once."""
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights must be positive")
    order = sorted(weights, key=lambda s: (s is None, s))
    exact = [Fraction(weights[s]) for s in order]
    whole = math.lcm(*(x.denominator for x in exact))
    part = [int(x * whole) for x in exact]
    total, ran, left = sum(part), [0] * len(order), sum(n > 0 for n in blocks.values())
    coming, ready, t = [(0, s) for s in range(len(order))], [], 0
    while left:
        while coming and coming[0][0] <= t:
            s = heapq.heappop(coming)[1]
            heapq.heappush(ready, (-(-(ran[s] + 1) * total // part[s]), s))
        s = heapq.heappop(ready)[1]
        ran[s] += 1
        heapq.heappush(coming, (ran[s] * total // part[s], s))
        left -= ran[s] == blocks[order[s]]
        t += 1
        yield order[s]


#: Slots that are written at a time.
PIECE = 1_000_000


def written_turns(spark: SparkSession, weights: Mapping[str | None, float], blocks: Mapping[str | None, int]) -> tuple[DataFrame, int]:
    """(source, block, epoch, slot) of every block of the mix, stored, and how many there are."""
    import numpy as np
    import pyarrow as pa

    order = sorted(weights, key=lambda s: (s is None, s))
    number = {s: i for i, s in enumerate(order)}
    size, ran = np.array([blocks[s] for s in order], np.int64), np.zeros(len(order), np.int64)
    path, piece, slots = shared_folder(spark, "mix-turns"), [], 0

    def write() -> None:
        nonlocal slots
        who = np.array(piece, np.int32)
        by = np.argsort(who, kind="stable")
        count = np.bincount(who, minlength=len(order))
        run = np.empty(len(who), np.int64)
        run[by] = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        run += ran[who]
        ran[:] += count
        rows = pa.table({"s": who, "block": run % size[who], "epoch": run // size[who], "slot": slots + np.arange(len(who))})
        spark.createDataFrame(rows).write.mode("append").parquet(path)
        slots += len(who)
        piece.clear()

    for source in turns(weights, blocks):
        piece.append(number[source])
        if len(piece) == PIECE:
            write()
    if piece:
        write()
    names = spark.createDataFrame([(i, s) for s, i in number.items()], "s int, _turn_source string")
    found = spark.read.schema("s int, block long, epoch long, slot long").parquet(path)
    return found.join(F.broadcast(names), "s").drop("s"), slots


#: So many blocks at most are sent to every executor.
BROADCAST_BLOCKS = 500_000


def schedule(spark, parts: Mapping[str | None, int]) -> DataFrame:
    """A schedule of whole parts that can be repeated: one period as rows (source, parts, period, slots): the slots that each source's blocks get, in order.

    The fold keeps, for each source, the number of blocks that ran. A source has index s in order of name.
    """
    period = sum(parts.values())
    order = sorted(parts, key=lambda s: (s is None, s))
    one = spark.createDataFrame([(list(range(len(order))), [parts[s] for s in order])], "ids array<int>, parts array<long>")

    def step(state, t):
        ran, w = state["ran"], F.col("parts")
        due = F.transform(F.col("ids"), lambda s: F.when(
            (F.get(ran, s) < F.get(w, s)) & (F.get(ran, s) * period <= t * F.get(w, s) + F.get(w, s) - 1),
            F.struct(F.expr("1L").alias("x"), s.alias("s"), F.get(ran, s).alias("i"), F.get(w, s).alias("w"))))
        ready = F.transform(F.filter(due, lambda x: x.isNotNull()), lambda x: F.struct(
            F.ceil((x["i"] + 1) * period / x["w"]).alias("deadline"), x["s"].alias("s")))
        pick = F.array_min(ready)["s"]
        return F.struct(F.zip_with(ran, F.col("ids"), lambda r, s: F.when(s == pick, r + 1).otherwise(r)).alias("ran"),
                        F.concat(state["out"], F.array(pick)).alias("out"))

    begin = F.struct(F.transform("ids", lambda s: F.lit(0).cast("long")).alias("ran"), F.array().cast("array<int>").alias("out"))
    slots = one.select(F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)).cast("array<long>"), begin, step)["out"].alias("out"))
    by = slots.select(F.posexplode("out").alias("slot", "s")).groupBy("s").agg(F.sort_array(F.collect_list(F.col("slot").cast("long"))).alias("slots"))
    names = spark.createDataFrame([(i, s, parts[s], period) for i, s in enumerate(order)], "s int, source string, parts long, period long")
    return names.join(by, "s").select("source", "parts", "period", "slots")


def tempered(df: DataFrame, source: str = "source", temper: float = TEMPER) -> dict[str | None, float]:
    """Weights: each source's share of the rows to the power of temper."""
    return {r[0]: r[1] ** temper for r in df.groupBy(source).count().collect()}


OWN = ("block", "epoch", "slot", "place")


def _placed(df: DataFrame, weights: Mapping[str | None, float] | None, key: str, source: str, block_rows: int) -> DataFrame:
    """_mix_row (a row of df as a struct) with block, epoch, slot and place; df has rows."""
    spark = df.sparkSession
    weights = tempered(df, source) if weights is None else weights
    counts = {r[0]: r[1] for r in df.groupBy(source).count().collect()}  # a row per source, as the weights are
    if missing := set(counts) - set(weights):
        raise ValueError(f"no weight for {sorted(map(str, missing))[:5]}")
    rows = df.select(F.struct(*df.columns).alias("_mix_row"), F.col(key).alias("_mix_key"), F.col(source).alias("_mix_source"),
                     F.xxhash64(*df.columns).alias("_mix_tie"))
    met, n = written_turns(spark, {s: weights[s] for s in counts}, {s: -(-n // block_rows) for s, n in counts.items()})
    met = met.withColumnRenamed("block", "_turn_block")
    ranked = numbered(rows, ["_mix_source"], ["_mix_key", "_mix_tie"], "rank", sum(counts.values())).withColumn("block", F.floor(F.col("rank") / block_rows))
    used = ranked.join(F.broadcast(met) if n <= BROADCAST_BLOCKS else met,
                       ranked["_mix_source"].eqNullSafe(met["_turn_source"]) & (F.col("block") == F.col("_turn_block")))
    return used.select("_mix_row", "block", "epoch", "slot", (F.col("rank") % block_rows).alias("place"))


def positions(df: DataFrame, weights: Mapping[str | None, float] | None = None, key: str = "doc_id", source: str = "source",
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with block, epoch, slot and place: a row for each time the mix uses the row; (slot, place) orders the mix.

    Columns of df with these names are replaced.
    """
    rest = [c for c in df.columns if c.lower() not in OWN or c in (key, source)]
    if df.isEmpty():
        return df.select(*rest, *[F.lit(0).cast("long").alias(c) for c in OWN])
    placed = _placed(df, weights, key, source, block_rows)
    return placed.select(*[F.col(f"_mix_row.{c}").alias(c) for c in rest], *OWN)


def mix(df: DataFrame, weights: Mapping[str | None, float] | None = None, key: str = "doc_id", source: str = "source",
        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of the mix in its order, columns as they were: a written copy keeps the order of files and rows."""
    if df.isEmpty():
        return df
    return _placed(df, weights, key, source, block_rows).orderBy("slot", "place").select("_mix_row.*")
