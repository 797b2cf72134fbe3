"""Null rules that differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_empty(c: Column | str) -> Column:
    """The empty string is NULL in the source dialect."""
    return F.nullif(col(c), F.lit(""))


def glue(*parts: Column | str) -> Column:
    """Concatenation in which a NULL part disappears instead of nulling the result."""
    return F.concat_ws("", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def ne_or_null(c: Column | str, value) -> Column:
    """True when the column is NULL or differs from value."""
    return ~col(c).eqNullSafe(value if isinstance(value, Column) else F.lit(value))


def differs(a: Column | str, b: Column | str, sentinel=None) -> Column:
    """Null-safe inequality; with a sentinel, a NULL also equals that very value."""
    if sentinel is None:
        return ~col(a).eqNullSafe(col(b))
    return F.coalesce(col(a), F.lit(sentinel)) != F.coalesce(col(b), F.lit(sentinel))


def differs_nocase(a: Column | str, b: Column | str, sentinel=None) -> Column:
    return differs(F.lower(col(a)), F.lower(col(b)), None if sentinel is None else sentinel.lower())


def if_set(c: Column | str, then, otherwise) -> Column:
    return F.nvl2(col(c), then if isinstance(then, Column) else F.lit(then),
                  otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def nz(c: Column | str) -> Column:
    """NULL for zero, so that averages and divisions skip it."""
    return F.nullif(col(c), F.lit(0))


def first_set(*cols: Column | str) -> Column:
    return F.coalesce(*[col(c) for c in cols])


def asc(c: Column | str) -> Column:
    """Ascending with NULLs last, the source dialect's default."""
    return col(c).asc_nulls_last()


def desc(c: Column | str) -> Column:
    """Descending with NULLs first, the source dialect's default."""
    return col(c).desc_nulls_first()
