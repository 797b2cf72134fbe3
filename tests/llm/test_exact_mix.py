"""Distance of the mix from the weights as given."""

from collections import Counter
from fractions import Fraction

import pytest

from fleetscope.llm import mixing

CASES = [
    ({"big": 1 / 3} | {f"s{i:02}": 2 / 57 for i in range(19)}, {"big": 2000} | {f"s{i:02}": 200 for i in range(19)}),  # 5 blocks off in every 1,000
    ({"all": 1e5, "tiny": 1.0}, {"all": 20_000, "tiny": 1}),  # far less than one slot in 1,000
    ({"a": 0.123456789, "b": 0.7, None: 0.017}, {"a": 700, "b": 3000, None: 50}),
]


def off(order, weights):
    """Largest distance, in blocks, of a source from its weight after any slot."""
    total, seen, worst = sum(map(Fraction, weights.values())), Counter(), 0
    shares = {s: float(Fraction(w) / total) for s, w in weights.items()}
    for t, s in enumerate(order, 1):
        seen[s] += 1
        worst = max(worst, max(abs(seen[k] - t * w) for k, w in shares.items()))
    return worst


@pytest.mark.parametrize("weights, blocks", CASES)
def test_turns(weights, blocks):
    order = list(mixing.turns(weights, blocks))
    assert off(order, weights) < 1
    ran = Counter(order)
    assert all(ran[s] >= n for s, n in blocks.items()) and any(order[-1] == s and ran[s] == n for s, n in blocks.items())


def test_mix_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 1500)
    weights, blocks = CASES[0]
    rows = [(i, s) for s, n in blocks.items() for i in range(n)]
    got = mixing.positions(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=1).collect()
    order = [r["source"] for r in sorted(got, key=lambda r: r["slot"])]
    assert sorted(r["slot"] for r in got) == list(range(len(got))) and off(order, weights) < 1
    assert Counter((r["doc_id"], r["source"]) for r in got if r["epoch"] == 0) == Counter(rows)
    turn = {}
    for r in sorted(got, key=lambda r: r["slot"]):
        n = turn[r["source"]] = turn.get(r["source"], -1) + 1
        assert (r["epoch"], r["block"]) == divmod(n, blocks[r["source"]])
