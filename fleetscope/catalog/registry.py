"""Registration of catalogue queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import Inputs, expected

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(inputs) -> DataFrame; sql is its expected result, None when SQL cannot say it."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            EXPECTED[name] = expected(sql)
        return fn

    return register


def rounded(num: str, den: str, scale: int = 0) -> str:
    """SQL text of a non-negative whole-number ratio rounded half up."""
    d = f"CAST({den} AS HUGEINT)"
    q = f"CAST((2 * {10**scale} * CAST({num} AS HUGEINT) + {d}) // nullif(2 * {d}, 0) AS BIGINT)"
    return q if scale == 0 else f"{q} / CAST({10**scale} AS DOUBLE)"
