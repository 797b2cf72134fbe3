"""Column expressions and frame helpers that the operators of this package share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import session

#: White space of the word rule: a word is a run of [^\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there and survives lost executors."""
    path = session.scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see."""
    return session.scratch_dir(spark, name)


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, rows: int, per_task: int = 4_000) -> DataFrame:
    """Adds out: 0, 1, 2 ... within each group, without bringing a group together in one task.

    Rows are dealt into buckets by the hash of the first order column; a running sum over the counts of the
    buckets gives each bucket its first number, and only the rows of one bucket are sorted. The numbers thus
    follow (bucket, hash, order), which is arbitrary but the same in every run. rows: how many rows df has, about.
    """
    n = max(1, math.ceil(rows / per_task))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(order[0]), F.lit(n)).cast("int"))
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (df.groupBy(*keys).count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
              .select(*[F.col(k).alias(f"_{k}_") for k in keys], "_start"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(order[0]), *order))
    met = [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in group] + [F.col("_bucket") == F.col("__bucket_")]
    ranked = df.withColumn("_in_bucket", inside)
    cond = met[0]
    for m in met[1:]:
        cond = cond & m
    return (ranked.join(starts, cond).withColumn(out, (F.col("_start") + F.col("_in_bucket") - 1).cast("long"))
            .drop("_bucket", "_in_bucket", "_start", *[f"_{k}_" for k in keys]))
