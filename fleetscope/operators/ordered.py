"""Order across tasks: positions, places and previous rows over all rows of a table.

Rows are dealt into ranges of the order, each range is numbered in a task of its own, and what crosses the borders (how many
rows lie before a range, and the last row before it) comes from one summary row per range. No window holds all rows of a
group, so a label or name that most rows share is as parallel as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint

PART, ROW = "_part", "_row"


def _columns(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _ranged(df: DataFrame, order: list, carry: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """df with its range and its place in it, and one row per range: how many rows lie before it, and the last of them.

    Both read the same written rows, so a range keeps its rows if a task runs again.
    """
    order = _columns(order)
    inside = Window.partitionBy(PART).orderBy(*order)
    ranged = df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id())
    ranged = ranged.withColumns({ROW: F.row_number().over(inside)} | {f"_before_{c}": F.lag(c).over(inside) for c in carry})
    ranged = checkpoint(ranged)
    last = F.struct(F.lit(True).alias("there"), *carry)
    ends = ranged.groupBy(PART).agg(F.count(F.lit(1)).alias("n"), F.max_by(last, ROW).alias("last"))
    earlier = Window.orderBy(PART)
    return ranged, ends.select(F.col(PART).alias("_of"), F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
                               F.lag("last").over(earlier).alias("_last"))


def position(df: DataFrame, order: list, out: str = "position") -> DataFrame:
    """df with its number in the order (1, 2, 3 ...); rows that the order doesn't tell apart are numbered as they come."""
    ranged, ends = _ranged(df, order)
    met = ranged.join(F.broadcast(ends), F.col(PART) == F.col("_of"))  # a row per range
    return met.withColumn(out, (F.col("_start") + F.col(ROW)).cast("bigint")).select(*df.columns, out)


def with_previous(df: DataFrame, order: list, cols: list[str], prefix: str = "previous_") -> DataFrame:
    """df with the given columns of the row before it in the order, and whether there is such a row (has_previous)."""
    ranged, ends = _ranged(df, order, cols)
    first = F.col(ROW) == 1
    met = ranged.join(F.broadcast(ends), F.col(PART) == F.col("_of"))
    return met.select(*[F.col(c) for c in df.columns],
                      *[F.when(first, F.col(f"_last.{c}")).otherwise(F.col(f"_before_{c}")).alias(f"{prefix}{c}") for c in cols],
                      (~first | F.col("_last.there").isNotNull()).alias("has_previous"))


def places(df: DataFrame, group: list[str], value: str, out: str = "place", descending: bool = False) -> DataFrame:
    """df with the dense rank of value within its group, nulls last: equal values share a place, no place is left out.

    Only the distinct values of the groups are put in order; rows get their place by a join.
    """
    by = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    seen = position(df.select(*group, value).distinct(), [*[F.col(c).asc_nulls_first() for c in group], by], "_at")
    starts = seen.groupBy(*group).agg(F.min("_at").alias("_from"))
    names = [*group, value]
    seen = _meet(seen, starts, group).select(*[F.col(c).alias(f"_k_{c}") for c in names], (F.col("_at") - F.col("_from") + 1).alias(out))
    cond = F.lit(True)
    for c in names:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(seen, cond).select(*df.columns, out)


def _meet(rows: DataFrame, per_group: DataFrame, group: list[str]) -> DataFrame:
    """rows with the columns of their group's row; null keys are keys."""
    if not group:
        return rows.crossJoin(F.broadcast(per_group))  # one row
    named = per_group.select(*[F.col(c).alias(f"_g_{c}") for c in group], *[c for c in per_group.columns if c not in group])
    cond = F.lit(True)
    for c in group:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return rows.join(named, cond).drop(*[f"_g_{c}" for c in group])
