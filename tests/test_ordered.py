"""Order across tasks against plain Python, with labels that most rows share, nulls and repeated rows."""

import random

from pyspark.sql import functions as F

from fleetscope.operators import ordered

SCHEMA = "id long, label string, value long"


def _rows(n=3000, seed=3):
    r = random.Random(seed)
    return [(i, r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, *range(40)])) for i in range(n)]


def _last(x):
    return (x is None, x if x is not None else 0)


def test_positions(spark):
    rows = _rows()
    got = ordered.position(spark.createDataFrame(rows, SCHEMA).repartition(7), [F.col("value").desc_nulls_last(), "id"]).collect()
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert [(r["id"], r["label"], r["value"]) for r in sorted(got, key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in got) == list(range(1, len(rows) + 1))


def test_previous_rows_cross_the_borders_of_tasks(spark):
    rows = _rows()
    got = ordered.with_previous(spark.createDataFrame(rows, SCHEMA), ["id"], ["label", "value"]).collect()
    before = {i: rows[i - 1] if i else (None, None, None) for i, *_ in rows}
    assert all((r["previous_label"], r["previous_value"], r["has_previous"]) == (*before[r["id"]][1:], r["id"] > 0) for r in got)
    assert len(got) == len(rows)


def test_places(spark):
    rows = _rows()
    for down in (False, True):
        got = ordered.places(spark.createDataFrame(rows, SCHEMA), ["label"], "value", descending=down).collect()
        want = {}
        for label in {r[1] for r in rows}:
            values = sorted({r[2] for r in rows if r[1] == label}, key=lambda v: (v is None, (-1 if down else 1) * (v or 0)))
            want |= {(label, v): i for i, v in enumerate(values, 1)}
        assert len(got) == len(rows) and all(r["place"] == want[r["label"], r["value"]] for r in got)


def test_nothing_and_one_row(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ordered.position(none, ["id"]).count() == 0 and ordered.with_previous(none, ["id"], ["label"]).count() == 0
    one = spark.createDataFrame([(1, None, None)], SCHEMA)
    assert [tuple(r) for r in ordered.places(one, ["label"], "value").collect()] == [(1, None, None, 1)]
    assert [tuple(r) for r in ordered.places(one, [], "value").collect()] == [(1, None, None, 1)]
