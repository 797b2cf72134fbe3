"""Shards of near equal bytes by a k-d tree over metadata.

The space of the metadata dimensions is split again and again: a node takes its widest dimension (relative to the
whole table) and is cut where the bytes on either side are in proportion to the numbers of shards below, which is
the weighted median when these are equal. Leaves of one shard each remain, all near total / shards bytes.

The points of the tree are groups of equal texts, with the bytes of all copies as weight and the metadata of the
row with the least key as coordinates, so copies share a shard. A group above a tenth of a shard (and above the
largest single row) is cut into points by the hash of the key first: no group can unbalance a shard.

Cuts are found in rounds for all nodes of a level at once: bytes per bin of the node's range, then the bins of
the one that holds the cut, down to a single value, and then the same among the points of that value. Only one
row per node comes to the driver, and the tree has as many cuts as shards less one.

Null texts have no bytes and are a group of equal texts (with crc32 zero, like the empty text), null metadata lies
below all other values, null keys are allowed, repeated rows are rows. An empty table gives an empty result.
Dimensions are whole numbers between -2^61 and 2^61; text dimensions count by their crc32.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from .exprs import numbered, stored

BINS = 4096
#: Bytes that every row takes besides its text.
ROW_BYTES = 16
#: A cut is near enough when the bytes it could still move are so many shares of a shard.
TOLERANCE = 0.0005


@dataclass
class Node:
    shards: int
    first: int
    dim: int = -1
    value: int = 0
    tie: int = 0
    left: Node | None = None
    right: Node | None = None


def _place(node: Node, leaf: Column | None = None) -> Column:
    """The first shard of the leaf that a point is in."""
    if node.left is None:
        return F.lit(node.first)
    d = F.col(f"_d{node.dim}")
    return F.when((d < node.value) | (d == node.value) & (F.col("_tie") < node.tie), _place(node.left)).otherwise(_place(node.right))


def _cuts(points: DataFrame, at: Column, nodes: list[tuple[Node, int, int, int, float]], tolerance: float) -> dict[int, tuple[int, int]]:
    """(value, tie) of the cut of each (node, dimension, least, greatest, bytes wanted on the left)."""
    spark, open_, done = points.sparkSession, {}, {}
    for n, dim, lo, hi, want in nodes:
        open_[n.first] = (dim, lo, hi, want, None)  # None: still among values; else the value whose points are cut
    while open_:
        rows = [(f, dim, lo, -(-(hi - lo + 1) // BINS), value is not None, value or 0) for f, (dim, lo, hi, _, value) in open_.items()]
        todo = spark.createDataFrame(rows, "_n int, _dim int, _lo long, _step long, _fine boolean, _value long")
        dims = F.array(*[F.col(c) for c in points.columns if c.startswith("_d")])
        here = points.withColumn("_at", at).join(F.broadcast(todo), F.col("_at") == F.col("_n"))  # a row per shard at most
        d = F.get(dims, F.col("_dim"))
        here = here.where(~F.col("_fine") | (d == F.col("_value"))).withColumn("_x", F.when(F.col("_fine"), F.col("_tie")).otherwise(d) - F.col("_lo"))
        bins = here.where("_x >= 0").groupBy("_n", F.expr("_x div _step").alias("_bin")).agg(F.sum("_w").alias("w"))
        bins = bins.where(f"_bin < {BINS}")
        want = spark.createDataFrame([(f, float(w)) for f, (_, _, _, w, _) in open_.items()], "_k int, want double")
        upto = F.sum("w").over(Window.partitionBy("_n").orderBy("_bin"))
        found = bins.withColumn("upto", upto).join(F.broadcast(want), F.col("_n") == F.col("_k")).where("upto >= want").groupBy("_n").agg(
            F.min(F.struct("_bin", "upto", "w")).alias("b"))
        got = {r["_n"]: r["b"] for r in found.collect()}
        for f, (dim, lo, hi, want_, value) in list(open_.items()):
            step, b = -(-(hi - lo + 1) // BINS), got.get(f)
            if b is None:  # all bytes are wanted on the left
                done[f] = (hi + 1, -1) if value is None else (value, hi + 1)
                del open_[f]
                continue
            a, below = lo + b["_bin"] * step, b["upto"] - b["w"]
            if step == 1 and value is None:
                open_[f] = (dim, 0, (1 << 62) - 1, want_ - below, a)
            elif b["w"] <= tolerance or step == 1:
                near = a if want_ - below < b["w"] / 2 else a + step
                done[f] = (near, -1) if value is None else (value, near)
                del open_[f]
            else:
                open_[f] = (dim, a, min(hi, a + step - 1), want_ - below, value)
    return done


def tree(points: DataFrame, dims: int, shards: int, total: int) -> Node:
    """The k-d tree over points with columns _d0 .. , _tie and _w."""
    root = Node(shards, 0)
    leaves, spread = [root], None
    while todo := [n for n in leaves if n.shards > 1]:
        at = _place(root)
        stats = points.groupBy(at.alias("n")).agg(F.sum("_w").alias("w"), *[f(f"_d{i}").alias(f"{k}{i}") for i in range(dims) for k, f in (("lo", F.min), ("hi", F.max))])
        seen = {r["n"]: r for r in stats.collect()}
        if spread is None:
            spread = [max(1, seen[0][f"hi{i}"] - seen[0][f"lo{i}"]) for i in range(dims)]
        wanted = []
        for n in todo:
            if (r := seen.get(n.first)) is None:
                n.dim, n.value, n.tie = 0, 0, -1
            else:
                n.dim = max(range(dims), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / spread[i], -i))
                wanted.append((n, n.dim, r[f"lo{n.dim}"], r[f"hi{n.dim}"], r["w"] * (n.shards // 2) / n.shards))
        cuts = _cuts(points, at, wanted, TOLERANCE * total / shards)
        for n in todo:
            n.value, n.tie = cuts.get(n.first, (n.value, n.tie))
            n.left, n.right = Node(n.shards // 2, n.first), Node(n.shards - n.shards // 2, n.first + n.shards // 2)
            leaves.remove(n)
            leaves += [n.left, n.right]
    return root


def shard(df: DataFrame, shards: int, dims: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot of every row of df; slot counts the rows of a shard from 0."""
    coords = [F.coalesce(F.crc32(F.col(c).cast("string")) if isinstance(df.schema[c].dataType, StringType) else F.col(c).cast("long"), F.lit(-1).cast("long")).alias(f"_d{i}")
              for i, c in enumerate(dims)]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(df.select(F.col(key).alias("key"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
                            F.xxhash64(body).alias("_hash"), *coords), "shard-rows")
    n, total, most = rows.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    group, out = ["_hash", "text_crc32", "size"], ["key", "size", "text_crc32", "shard", "slot"]
    if not n:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).select(*out)
    limit = max(most, total // (10 * shards))
    hot = rows.groupBy(*group).agg(F.sum("size").alias("_all")).where(F.col("_all") > limit)  # 10 * shards groups at most
    hot = hot.select(*group, F.ceil(F.col("_all") / limit).cast("int").alias("_pieces"))
    rows = rows.join(F.broadcast(hot), group, "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64("key"), F.col("_pieces")).cast("int"), F.lit(0)))
    names = [f"_d{i}" for i in range(len(dims))]
    points = rows.groupBy(*group, "_piece").agg(F.sum("size").alias("_w"), F.min(F.struct("key", *names)).alias("_first")).select(
        *group, "_piece", "_w", *[f"_first.{c}" for c in names], F.shiftrightunsigned(F.xxhash64("_hash", "text_crc32", "_piece"), 2).alias("_tie"))
    points = stored(points, "shard-points")
    placed = points.select(*group, "_piece", _place(tree(points.select(*names, "_tie", "_w"), len(dims), shards, total)).alias("shard"))
    slim = rows.select("key", *group, "_piece").join(placed, [*group, "_piece"]).select("key", "size", "text_crc32", "shard")
    return numbered(slim, ["shard"], ["key", "text_crc32", "size"], "slot", n).select(*out)


def write_shards(df: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """The rows of df, each in the folder shard=<shard> of path. Keys must be unique and not null."""
    where = placed.select(F.col("key").alias("_key"), "shard")
    df.join(where, df[key] == where["_key"]).drop("_key").write.partitionBy("shard").parquet(path)
