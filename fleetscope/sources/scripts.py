"""Text sink for generated command lines."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_script(df: DataFrame, path: str, c: str = "line") -> None:
    """Write one command per line; rows without a command are left out."""
    df.where(f"{c} IS NOT NULL").select(c).write.mode("overwrite").text(path)
