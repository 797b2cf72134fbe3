"""The schedule's deviation, and what a mix holds."""

import random
from collections import Counter

import pytest

from fleetscope.llm import mixing

from .cases import documents, frame


@pytest.mark.parametrize("seed", range(4))
def test_less_than_one_block_off(spark, seed):
    r = random.Random(seed)
    parts = {f"s{i}": r.randint(1, 40) for i in range(r.randint(1, 9))}
    period, at = sum(parts.values()), {}
    for row in mixing.schedule(spark, parts).collect():
        assert len(row["slots"]) == parts[row["source"]]
        for i, t in enumerate(row["slots"]):
            assert i * period // parts[row["source"]] <= t < -(-(i + 1) * period // parts[row["source"]])
            at[t] = row["source"]
    assert sorted(at) == list(range(period))
    seen = Counter()
    for t in range(period):
        seen[at[t]] += 1
        assert all(abs(seen[s] * period - parts[s] * (t + 1)) < period for s in parts)


def test_parts():
    assert sum(mixing.parts_of({"a": 3, "b": 1e-9, None: 1}).values()) == mixing.PERIOD
    assert min(mixing.parts_of({i: 1.0 for i in map(str, range(900))}).values()) >= 1
    for bad in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.parts_of({"a": bad})


@pytest.mark.parametrize("weights", [None, {"hot": 1, "a": 1, "b": 1, None: 1}])
def test_mix(spark, weights):
    rows = documents() + documents()[:3]
    df = frame(spark, rows)
    got = mixing.positions(df, weights, block_rows=4).collect()
    assert len({(r["slot"], r["place"]) for r in got}) == len(got)
    first = Counter(r["doc_id"] for r in got if r["epoch"] == 0)
    assert first == Counter(r[0] for r in rows)  # every row once in the first epoch
    source = {}
    for r in got:
        assert source.setdefault(r["slot"], r["source"]) == r["source"]
    assert sorted(source) == list(range(len(source)))
    parts = mixing.parts_of(weights or mixing.tempered(df))
    period, seen = sum(parts.values()), Counter()
    for t in range(len(source)):
        seen[source[t]] += 1
        assert all(abs(seen[s] * period - parts[s] * (t + 1)) < period for s in parts)
    out = mixing.mix(df, weights, block_rows=4)
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["slot"], r["place"]))]
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == order


def test_missing_weight_and_empty(spark):
    with pytest.raises(ValueError):
        mixing.positions(frame(spark), {"hot": 1})
    empty = frame(spark, [])
    assert mixing.positions(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_native(spark):
    text = mixing.mix(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text
