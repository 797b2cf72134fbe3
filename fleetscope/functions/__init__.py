"""Column expressions: the reference dialect's null, rounding, text and time rules in Spark terms."""

from . import labels, nulls, numbers, text, times

__all__ = ["labels", "nulls", "numbers", "text", "times"]
