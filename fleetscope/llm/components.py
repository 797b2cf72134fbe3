"""Connected components of a graph of links, as Spark joins over the links alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .exprs import stored


def _star(e: DataFrame, small: bool) -> DataFrame:
    """One star operation: a node's neighbours (only the smaller ones if small) point to the least of them.

    Neighbours and least are joined, never listed, so the node in the middle of a large component is a skewed
    join key that Spark splits and not one group in one task.
    """
    both = e if small else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # here b is the node in the middle, a its neighbour
    least = both.groupBy("b").agg(F.least(F.min("a"), F.first("b")).alias("m")).withColumnRenamed("b", "c")
    met = both.join(least, both["b"] == least["c"])
    if small:
        out = met.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")).select(
            F.col("x.m").alias("a"), F.col("x.a").alias("b"))
    else:
        out = met.where(F.col("a") > F.col("b")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the links (a, b): root is the least node reachable; nodes without links have no row.

    Alternates large and small stars (Kiveris et al., 2014) until the links no longer change, which takes about
    log^2 of the longest path rounds. Every round is written to the shared folder.
    """
    e = links.where("a is not null and b is not null and a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = stored(e, "links")

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])

    seen = sign(e)
    while seen[0]:
        e = stored(_star(_star(e, small=False), small=True), "links")
        now = sign(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
