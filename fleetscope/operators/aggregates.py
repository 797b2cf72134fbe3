"""General aggregations: string lists, EAV pivots, histograms, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import col


def agg_list(c: Column | str, sep: str = ",") -> Column:
    """Sorted values joined by sep; NULL values are left out."""
    return F.nullif(F.array_join(F.array_sort(F.collect_list(col(c))), sep), F.lit(""))


def with_total(df: DataFrame, value: str, total: str = "total") -> DataFrame:
    """Adds the sum of a column over all rows: rows that are counted already are summed, and their shuffle is used again."""
    return df.withColumn(total, df.agg(F.sum(value)).scalar())
