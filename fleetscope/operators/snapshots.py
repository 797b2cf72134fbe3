"""Daily snapshots of a fleet: latest rows, differences between days, and long-to-wide pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.nulls import differs, ne_or_null
from ..functions.times import ts as stamp
from ..session import checkpoint
from .ordered import with_previous

DATE = "date_collected"


def live_instances(reg: DataFrame, types: tuple[str, ...] = ("single", "rac"), first_node: bool = False, billed: bool = False,
                   primary: bool = False) -> DataFrame:
    """Registered database instances that are not deleted; optionally one per cluster, billed, not standby."""
    keep = F.col("instance_type").isin(*types) & F.col("del_date").isNull()
    if first_node:
        keep &= (F.col("instance_type") == "single") | F.col("instance_name").like("%1")
    if billed:
        keep &= ne_or_null("billing_category", "None")
    if primary:
        keep &= ne_or_null("standby_status", "Standby")
    return reg.where(keep)


def on_date(hist: DataFrame, date, c: str = DATE) -> DataFrame:
    return hist.where(F.col(c) == stamp(date))


def pending_sources(reg: DataFrame, hist: DataFrame, date, inst: str = "inst_id") -> DataFrame:
    """Sources without a row on the date."""
    done = on_date(hist, date).select(F.col(inst).alias("id")).distinct()
    return reg.join(done, "id", "left_anti")


missing = pending_sources


def latest_snapshot(df: DataFrame, where: Column | str | None = None, c: str = DATE) -> DataFrame:
    """Rows of the latest date; where narrows which rows decide what the latest date is."""
    of = df if where is None else df.where(where)
    return df.where(F.col(c) == of.select(F.max(c)).scalar())


def latest_per_key(df: DataFrame, keys: list[str], c: str = DATE) -> DataFrame:
    """Rows of the latest date of each key. The date per key is aggregated first, so no key meets in one task."""
    return df.join(df.groupBy(*keys).agg(F.max(c).alias(c)), [*keys, c], "left_semi")


def last_dates(df: DataFrame, k: int, c: str = DATE) -> DataFrame:
    """The last k distinct dates."""
    return df.select(c).distinct().orderBy(F.col(c).desc_nulls_last()).limit(k)


def snapshot_dates(df: DataFrame, c: str = DATE) -> DataFrame:
    """Latest and previous date as one row."""
    return last_dates(df, 2, c).agg(F.max(c).alias("latest"), F.when(F.count(c) > 1, F.min(c)).alias("previous"))


def previous_snapshot(df: DataFrame, c: str = DATE) -> DataFrame:
    return df.where(F.col(c) == snapshot_dates(df, c).select("previous").scalar())


def last_two_snapshots(df: DataFrame, c: str = DATE) -> tuple[DataFrame, DataFrame]:
    """Rows of the latest and of the previous date. Both days are written out once, since comparisons read them several times."""
    both = checkpoint(df.join(last_dates(df, 2, c), c, "left_semi"))
    return latest_snapshot(both, c=c), previous_snapshot(both, c)


def _null_safe(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def diff_snapshots(prev: DataFrame, cur: DataFrame, keys: list[str], values: list[str], sentinel: str | None = None) -> DataFrame:
    """Two snapshots side by side on null-safe keys, with the kind of change and the names of changed values.

    With a sentinel, NULL and the sentinel count as the same value.
    """
    p = prev.select(*keys, *values).withColumn("_in", F.lit(True)).alias("p")
    q = cur.select(*keys, *values).withColumn("_in", F.lit(True)).alias("q")
    joined = p.join(q, _null_safe("p", "q", keys), "full")
    changed = {v: differs(F.col(f"p.{v}"), F.col(f"q.{v}"), sentinel) for v in values}
    names = F.array_compact(F.array(*[F.when(c, F.lit(v)) for v, c in changed.items()]))
    kind = (F.when(F.col("p._in").isNull(), "added").when(F.col("q._in").isNull(), "deleted")
            .when(reduce(lambda a, b: a | b, changed.values()), "changed").otherwise("same"))
    return joined.select(
        *[F.coalesce(F.col(f"p.{k}"), F.col(f"q.{k}")).alias(k) for k in keys],
        *[F.col(f"p.{v}").alias(f"previous_{v}") for v in values], *[F.col(f"q.{v}").alias(f"current_{v}") for v in values],
        kind.alias("change"), F.array_join(names, ",").alias("changed"))


def added(prev: DataFrame, cur: DataFrame, key: str) -> DataFrame:
    return cur.select(key).distinct().join(prev.select(key).distinct(), key, "left_anti")


def removed(prev: DataFrame, cur: DataFrame, key: str) -> DataFrame:
    return added(cur, prev, key)


def change_history(hist: DataFrame, keys: list[str], value: str, c: str = DATE, sentinel: str | None = "1", nocase: bool = True) -> DataFrame:
    """Each value together with what it was changed to and when; unchanged dates are left out.

    hist holds one row per key and date, so a window sees at most one row per collection date.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(c).desc_nulls_first())
    out = hist.withColumns({"changed_to": F.lag(value).over(w), "changed_at": F.lag(c).over(w)})
    a, b = (F.lower(value), F.lower("changed_to")) if nocase else (F.col(value), F.col("changed_to"))
    return out.where(differs(a, b, sentinel) & F.col("changed_at").isNotNull())


def eav_wide(hist: DataFrame, names: dict[str, str], target: list[str], name: str = "param_name", value: str = "param_value",
             required: tuple[str, ...] = (), keep: dict[str, Column] | None = None) -> DataFrame:
    """Parameters as columns in one pass; targets lacking a required one are dropped."""
    rows = hist.where(F.col(name).isin(list(names)))
    wide = rows.groupBy(*target).agg(
        *[F.max(F.when(F.col(name) == n, F.col(value))).alias(a) for n, a in names.items()],
        *[F.max(F.when(F.col(name) == n, F.lit(True))).alias(f"_has_{a}") for n, a in names.items() if n in required],
        *[c.alias(a) for a, c in (keep or {}).items()])
    for n in required:
        wide = wide.where(F.col(f"_has_{names[n]}")).drop(f"_has_{names[n]}")
    return wide


def collection_status(reg: DataFrame, hist: DataFrame, name: str, date, inner: bool = False) -> DataFrame:
    """Every instance with its value (or error text) of the date, or 'Not collected'."""
    rows = on_date(hist, date).where(F.col("param_name") == name).select(F.col("inst_id").alias("id"), "param_value")
    return reg.join(rows, "id", "inner" if inner else "left").withColumn("status_text", F.coalesce("param_value", F.lit("Not collected"))).drop("param_value")


def param_report(reg: DataFrame, hist: DataFrame, name: str, strict_where: bool = False, any_param: bool = False) -> DataFrame:
    """One parameter of every instance at its latest collection.

    The history is narrowed before the join, so instances without a current row stay. strict_where
    filters afterwards instead: an instance that only has older rows disappears.
    """
    mine = hist.where(F.col("param_name") == name)
    latest = (hist if any_param else mine).select(F.max(DATE)).scalar()
    cols = mine.select(F.col("inst_id").alias("id"), "param_name", "param_value", "spparam_value", DATE)
    if strict_where:
        return reg.join(cols, "id", "left").where(F.col(DATE).isNull() | (F.col(DATE) == latest))
    return reg.join(cols.where(F.col(DATE) == latest), "id", "left")


def coverage(reg: DataFrame, hist: DataFrame, date) -> DataFrame:
    """Collected against expected number of sources, as one row."""
    return reg.agg(F.count_distinct("id").alias("expected")).withColumn(
        "collected", on_date(hist, date).select(F.count_distinct("inst_id")).scalar())


def suppress_repeats(df: DataFrame, labels: list[str], order: list[str]) -> DataFrame:
    """Blank a label that equals the one on the previous line of the report (within the first label, which every change shows).

    Lines are dealt into ranges of the report's order and the last line of a range is carried over its border, so lines of
    one label are as many tasks' work as needed. order must continue the labels to a total order of the lines.
    """
    nulls_last = [F.col(c).asc_nulls_last() for c in (*labels, *order)]
    lines = with_previous(df, nulls_last, labels)
    top = labels[0]
    new = ~F.col("has_previous") | ~F.col(top).eqNullSafe(F.col(f"previous_{top}"))
    shows = {c: new | ne_or_null(c, F.col(f"previous_{c}")) if i else new for i, c in enumerate(labels)}
    return lines.select(*[F.when(F.coalesce(shows[c], F.lit(False)), F.col(c)).alias(f"shown_{c}") for c in labels], *[F.col(c) for c in df.columns])
