"""Set operations and row generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_tagged(parts: dict[str, DataFrame], tag: str = "branch") -> DataFrame:
    """All rows of several branches, each marked with its name."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_distinct(*parts: DataFrame) -> DataFrame:
    """Union without duplicates: equal rows of different branches collapse."""
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def replicate(df: DataFrame, n: int, name: str = "copy_no") -> DataFrame:
    """Every row n times, numbered from 1; no shuffle."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))
