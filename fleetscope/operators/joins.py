"""Joins. No hint is given: small sides are broadcast by their measured size, hot keys are split at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint


def enrich(df: DataFrame, dim: DataFrame, on: str | list[str]) -> DataFrame:
    """Add the columns of an optional dimension."""
    return df.join(dim, on, "left")


def with_snapshot(stat: DataFrame, snap: DataFrame, on: tuple[str, ...] = ("snap_id", "instance_number")) -> DataFrame:
    """Facts with the end time of their snapshot."""
    return stat.join(snap, list(on))


def compare(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Two sides next to each other, keys merged; a key missing on one side leaves NULLs there."""
    tag = lambda df, n: df.select(*keys, *[F.col(c).alias(f"{n}_{c}") for c in df.columns if c not in keys])
    return tag(left, names[0]).join(tag(right, names[1]), keys, "full")


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows without a partner; NULL keys have none."""
    return df.join(keys, on, "left_anti")


def not_in(df: DataFrame, other: DataFrame, cols: list[str], null_safe: bool = True) -> DataFrame:
    """Rows of df whose value combination does not occur in other.

    null_safe treats NULL as a value; otherwise SQL's NOT IN rule holds: a row is dropped as soon
    as a combination of other could equal it when its NULLs are filled in.
    """
    if null_safe:
        # presence flags next to the values keep NULL apart from every real value, and the join an equi-join
        flagged = lambda d: d.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(cols)],
                                     *[F.isnull(c).alias(f"_n{i}") for i, c in enumerate(cols)])
        marks = [f"_k{i}" for i in range(len(cols))] + [f"_n{i}" for i in range(len(cols))]
        tagged = df.withColumns({f"_k{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(cols)}
                                | {f"_n{i}": F.isnull(c) for i, c in enumerate(cols)})
        return tagged.join(flagged(other).distinct(), marks, "left_anti").drop(*marks)
    return _not_in_with_nulls(df, other, cols)


def _not_in_with_nulls(df: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    """NOT IN where a NULL may stand for any value, with a plan of constant size.

    Two combinations could be equal if they agree in the columns that both have set. Which columns those are follows
    from the two null patterns, so every distinct combination gets one key per pattern of the other side that occurs:
    both patterns, and its values in the common columns. One equi semi join of the keys finds the combinations to drop.
    Distinct combinations are written out, since patterns and keys both come from them.
    """
    values, others = checkpoint(df.select(*cols).distinct()), checkpoint(other.select(*cols).distinct())
    pattern = F.concat(*[F.when(F.isnull(c), "0").otherwise("1") for c in cols])

    def keyed(d: DataFrame, against: DataFrame, mine_first: bool) -> DataFrame:
        theirs = against.select(F.array_sort(F.collect_set(pattern))).scalar()  # 2 ** len(cols) at most
        out = d.select(*cols, pattern.alias("_mine"), F.explode(theirs).alias("_theirs"))
        common = F.array(*[F.when(F.substring("_theirs", i, 1) == "1", F.col(c).cast("string")) for i, c in enumerate(cols, 1)])
        pair = ("_mine", "_theirs") if mine_first else ("_theirs", "_mine")
        return out.select(*cols, F.struct(*[F.col(x).alias(n) for x, n in zip(pair, "lr")], common.alias("v")).alias("_key"))

    dropped = keyed(values, others, True).join(keyed(others, values, False).select("_key").distinct(), "_key", "left_semi").select(*cols).distinct()
    return not_in(df, dropped, cols)


def match_running_stored(running: DataFrame, stored: DataFrame, multi: list[str], keys: tuple[str, ...] = (),
                         strict: bool = False) -> DataFrame:
    """Running and stored parameters side by side.

    Parameters named in multi may have many lines and match on their value; all others match on
    the name alone. Under strict, a running single-valued parameter without a value never matches,
    so such a name shows up once per side.
    """
    many = F.col("name").isin(multi)
    single = F.when(F.col("value").isNotNull(), F.lit("")) if strict else F.lit("")
    r = running.select(*keys, "name", F.when(many, F.col("value")).otherwise(single).alias("_match"), F.lit(True).alias("_running"),
                       *[F.col(c).alias(f"running_{c}") for c in running.columns if c not in (*keys, "name")])
    s = stored.select(*keys, "name", F.when(many, F.col("value")).otherwise(F.lit("")).alias("_match"),
                      *[F.col(c).alias(f"stored_{c}") for c in stored.columns if c not in (*keys, "name")])
    return r.join(s, [*keys, "name", "_match"], "full").drop("_match", "_running")


def capped_join_count(a: DataFrame, b: DataFrame, on: str, cap: int) -> DataFrame:
    """How many pairs an equi-join yields, up to cap, from the key counts alone."""
    left = a.groupBy(on).agg(F.count(F.lit(1)).alias("n_a"))
    right = b.groupBy(on).agg(F.count(F.lit(1)).alias("n_b"))
    pairs = F.sum(F.col("n_a").cast("decimal(38,0)") * F.col("n_b"))
    return left.join(right, on).agg(F.least(F.coalesce(pairs, F.lit(0)), F.lit(cap).cast("decimal(38,0)")).cast("bigint").alias("cnt"))


def samples_of_text(s: DataFrame, statements: DataFrame, like: str) -> DataFrame:
    """Samples whose statement text matches a pattern, once per matching statement row."""
    return s.join(statements.where(F.col("sql_text").like(like)).select("sql_id", "sql_text"), "sql_id")


def live_vs_sample(sessions: DataFrame, s: DataFrame, state: str | None = None) -> DataFrame:
    """Live sessions that appear in the latest sample, counted by what they do now."""
    from .filters import at_latest

    seen = at_latest(s)
    if state:
        seen = seen.where(F.col("session_state") == state)
    return (sessions.join(seen.select(F.col("session_id").alias("sid"), "event"), "sid")
            .groupBy("wait_class", "status", "event").agg(F.count(F.lit(1)).alias("cnt")))


def scalar_lookup(df: DataFrame, dim: DataFrame, on: str, value: str, name: str) -> DataFrame:
    """One value per row from a dimension with a unique key."""
    return df.join(dim.select(on, F.col(value).alias(name)), on, "left")


def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a single-row aggregate as scalar subqueries."""
    return df.withColumns({c: one.select(c).scalar() for c in one.columns})



def ordinal_lookup(df: DataFrame, ordinal: str, names: list[str], name: str) -> DataFrame:
    """Attach the n-th name of an ordered list by its number, counting from 1; other numbers give NULL."""
    numbered = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names, 1)], f"{ordinal} long, {name} string")
    return df.join(numbered, ordinal, "left")
