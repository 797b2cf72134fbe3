"""Session samples: the in-memory view, the archive, or a saved copy, all with the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ARCHIVE_WEIGHT = 10  # fixed value: an archived sample stands for ten seconds


def weighted(df: DataFrame, weight: int) -> DataFrame:
    """Tag samples with the seconds each of them stands for."""
    return df.withColumn("weight", F.lit(weight))


def read_samples(spark: SparkSession, path: str, weight: int = 1) -> DataFrame:
    return weighted(spark.read.parquet(path), weight)


def save_extract(df: DataFrame, where: Column | str, path: str, partition_by: list[str] = ()) -> None:
    """Keep the matching rows beyond the life of their source."""
    out = df.where(where).write.mode("errorifexists")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
