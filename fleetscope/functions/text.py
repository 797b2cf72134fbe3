"""Text normalisation and extraction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import col, null_if_empty


def digits_to_n(c) -> Column:
    return F.regexp_replace(col(c), r"\d", "n")


def program_label(program, session_type) -> Column:
    """Background and worker programs by their role, all others by the name before the host, in brackets.

    The role is the last bracket of the program's text and marks a worker if it is J or P and a number. Numbers
    become n. A missing program has an empty name.
    """
    p = F.coalesce(col(program), F.lit(""))
    role = F.regexp_extract(p, r"\([^(]*$", 0)
    name = F.substring_index(p, "@", 1)
    worker = role.rlike(r"^\([JP]\d+\)")
    label = F.when((col(session_type) == "BACKGROUND") | worker, F.when(role == "", p).otherwise(role)).otherwise(F.concat(F.lit("("), name, F.lit(")")))
    return F.concat(digits_to_n(label), F.lit(" "))


def title_case(c) -> Column:
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**30)))


def version_from_path(c) -> Column:
    """The part of a home path that is a dotted version number, such as 19.0.0."""
    dotted = F.filter(F.split(col(c), "/"), lambda x: x.rlike(r"^\d{2}(\.\d+)+$"))
    return F.get(dotted, F.lit(0))


def acl_owner(c) -> Column:
    return null_if_empty(F.regexp_extract(col(c), r"owner:([A-Za-z0-9]*):", 1))


def acl_group(c) -> Column:
    return null_if_empty(F.regexp_extract(col(c), r"pgrp:([A-Za-z0-9]*):", 1))


SCHEDULE_XML = "IntervalSchedule STRUCT<_INTERVAL: STRING, _TIME_UNIT: STRING>"


def schedule(c) -> Column:
    """'<interval> <unit>' from a schedule XML text; the unit defaults to minutes."""
    node = F.from_xml(F.trim(col(c)), SCHEDULE_XML)["IntervalSchedule"]
    interval, unit = null_if_empty(node["_INTERVAL"]), null_if_empty(node["_TIME_UNIT"])
    return F.when(F.trim(col(c)) != "", F.concat_ws(" ", interval, F.coalesce(unit, F.lit("Min"))))


def digits_only(c) -> Column:
    return F.regexp_replace(col(c), r"[^\d]", "")


def arrow_change(before, after) -> Column:
    """'old' --> 'new' with quotes; an unset side is empty."""
    quoted = lambda c: F.concat(F.lit("'"), F.coalesce(col(c), F.lit("")), F.lit("'"))
    return F.concat(quoted(before), F.lit(" --> "), quoted(after))
