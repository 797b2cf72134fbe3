"""Ranking inside groups and Top-N rows laid out side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def rank_in(df: DataFrame, part: list[str], order: list[Column], ties: str = "row_number", name: str = "rnk") -> DataFrame:
    """Rank rows of each group; ties='rank' shares ranks, 'row_number' needs a total order."""
    fn = F.rank() if ties == "rank" else F.row_number()
    return df.withColumn(name, fn.over(Window.partitionBy(*part).orderBy(*order)))


def wide_aggregates(n: int, payload: list[str], rank: str = "rnk") -> list[Column]:
    """Aggregates that collect the rows ranked 1..n of a group, one struct each.

    Rows sharing a rank (ties='rank') are represented by the smallest payload.
    """
    return [F.min(F.when(F.col(rank) == k, F.struct(*payload))).alias(f"_top{k}") for k in range(1, n + 1)]


def unfold(n: int, payload: list[str]) -> list[Column]:
    return [F.col(f"_top{k}.{p}").alias(f"top{k}_{p}") for k in range(1, n + 1) for p in payload]


def top_n_wide(df: DataFrame, key: list[str], payload: list[str], order: list[Column], n: int,
               ties: str = "row_number") -> DataFrame:
    """The n best rows of each group as one row: one window and one aggregation, no self joins."""
    best = rank_in(df, key, order, ties).where(F.col("rnk") <= n)
    return best.groupBy(*key).agg(*wide_aggregates(n, payload)).select(*key, *unfold(n, payload))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of a total order."""
    return df.orderBy(*order).limit(k)
