"""Exact ratios and number formatting.

Ratios are computed from whole-number sums and rounded once, half away from zero, so a
result does not depend on the order in which Spark adds partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import col, nz

MIB = 1024 * 1024
GIB = 1024 * MIB


def _whole(c) -> Column:
    return (F.lit(c) if isinstance(c, int) else col(c)).cast("decimal(38,0)")


#: Decimal digits that one step of the long division appends.
STEP = 7
#: Twice a number below this, and a number below this added, still fit a bigint.
PLAIN_MOST = 3 * 10**18


def _long_division(n: Column, d: Column, scale: int) -> Column:
    """|n|/|d| * 10**scale of decimals, rounded half up: the remainder gives STEP more digits at a time."""
    size = F.nullif(F.abs(d), F.lit(0).cast("decimal(38,0)"))
    rest, whole, left = F.abs(n) % size, F.call_function("div", F.abs(n), size), scale
    value = whole.cast("decimal(38,0)")
    while left:
        k = min(left, STEP)
        more = rest * F.lit(10**k).cast("decimal(8,0)")
        value = value * F.lit(10**k).cast("decimal(8,0)") + F.call_function("div", more, size).cast("decimal(38,0)")
        rest, left = more.cast("decimal(38,0)") % size, left - k
    return value + F.when(rest * 2 >= size, 1).otherwise(0)


def ratio(num, den, scale: int = 0) -> Column:
    """num/den of whole numbers rounded once to scale digits, half away from zero; NULL when den is zero.

    Where both fit, one bigint division gives the digits. Others take a long division, exact for every divisor up to
    10**30. The whole part must fit a bigint. The two numbers are bound in a lambda, so each is computed once and the
    long division stays out of the generated code.
    """
    kind = "bigint" if scale == 0 else "double"
    most = PLAIN_MOST // 10**scale

    def digits(x: Column) -> Column:
        n, d, a, b = x["n"], x["d"], x["a"], x["b"]
        plain = a.between(-most, most) & b.between(1, PLAIN_MOST)
        units = F.call_function("div", F.abs(a) * (2 * 10**scale) + b, b * 2)
        long = _long_division(n, d, scale)
        return (F.when(plain & (a >= 0), units.cast(kind)).when(plain, (-units).cast(kind))
                .when((n < 0) != (d < 0), (-long).cast(kind)).otherwise(long.cast(kind)))

    n, d = _whole(num), _whole(den)
    pair = F.transform(F.array(F.struct(n.alias("n"), d.alias("d"))), lambda x: F.struct(
        x["n"].alias("n"), x["d"].alias("d"), x["n"].try_cast("bigint").alias("a"), x["d"].try_cast("bigint").alias("b")))
    found = F.get(F.transform(pair, digits), 0)
    return found if scale == 0 else found / F.lit(float(10**scale))


def avg_nz(c) -> Column:
    """Mean of the non-zero values."""
    return F.avg(nz(c))


def rounded_avg(c, unit: int = 1, scale: int = 0) -> Column:
    """Mean divided by unit, rounded."""
    return ratio(F.sum(col(c)), F.count(col(c)) * F.lit(unit), scale)


def rounded_avg_nz(c, unit: int = 1, scale: int = 0) -> Column:
    """Mean of the non-zero values divided by unit, rounded."""
    return rounded_avg(nz(c), unit, scale)


def scaled(c, unit: int, scale: int = 0) -> Column:
    """A whole number expressed in a bigger unit, rounded."""
    return ratio(c, unit, scale)


def utilisation(used, limit) -> Column:
    """Whole percent of a limit in use."""
    return ratio(col(used).cast("decimal(20,0)") * 100, limit, 0)


def to_number(c) -> Column:
    """Numeric value of a text; NULL when it is not a number."""
    return col(c).try_cast("decimal(38,4)")


def hex16(c) -> Column:
    """Sixteen hexadecimal digits, zero padded."""
    return F.lpad(F.hex(col(c)), 16, "0")


def from_hex(c) -> Column:
    """The unsigned number that up to sixteen hexadecimal digits say."""
    return F.conv(col(c), 16, 10).cast("decimal(20,0)")


def share(part, total) -> Column:
    """Right-aligned whole percent, five characters wide."""
    return F.lpad(F.concat(ratio(col(part).cast("decimal(20,0)") * 100, total, 0).cast("string"), F.lit("%")), 5, " ")


def count_if(cond: Column) -> Column:
    """How many rows meet the condition (a NULL condition does not count)."""
    return F.count(F.when(cond, F.lit(1)))


def sum_if(cond: Column, value) -> Column:
    return F.sum(F.when(cond, col(value)))
