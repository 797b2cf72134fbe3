"""Jaccard join against the exact similarity of all pairs."""

import random

import pytest

from fleetscope.llm import metric_join

from .cases import documents, frame
from .test_near_copies import families, plain

SCHEMA = "doc_id long, text string"


def want(texts):
    """n and component of every key; blank texts link with nothing."""
    full = {k: t for k, t in texts.items() if plain(t)}
    root = families(full)[0]
    return {k: (len(plain(t)), root.get(k, k)) for k, t in texts.items()}


def found(spark, texts, **how):
    out = metric_join.join(spark.createDataFrame(list(texts.items()), SCHEMA), **how).collect()
    assert len(out) == len(texts)
    return {r["key"]: (r["n"], r["component"]) for r in out}


def edited(r, words, share):
    """words with about so large a share of them changed, in few places."""
    out = list(words)
    for i in r.sample(range(len(out)), max(1, int(share * len(out)))):
        out[i] = f"new{r.randrange(10**6)}"
    return out


def groups(seed=21):
    """Prose, near copies around 0.8, chains, a passage that all share, and a family in which hardly any two link."""
    r, texts = random.Random(seed), {k: t for k, t, *_ in documents(seed=seed, n=60)}
    passage = [f"p{i}" for i in range(200)]
    for d in range(60):
        w = [f"w{r.randrange(5000)}" for _ in range(r.randint(20, 120))]
        at = r.randrange(len(w))
        texts |= {1000 + 2 * d: " ".join(w[:at] + passage + w[at:]), 1001 + 2 * d: " ".join(edited(r, w[:at] + passage + w[at:], r.uniform(0.005, 0.06))).upper()}
    base = [f"b{i}" for i in range(250)]
    texts |= {2000 + d: " ".join(edited(r, base, r.choice([0.01, 0.03, 0.05, 0.08]))) for d in range(120)}
    chain = [f"c{i}" for i in range(204)]
    texts |= {9000 + i: " ".join(chain[15 * i:] + [f"d{j}" for j in range(15 * i)]) for i in range(8)}
    return texts


@pytest.mark.parametrize("leaf", [metric_join.LEAF, 4])
def test_against_all_pairs(spark, leaf):
    """With small leaves the regions are dealt to pivots' cells over and over."""
    texts = groups()
    expected = want(texts)
    got = found(spark, texts, leaf=leaf)
    assert got == expected
    assert sum(k != c for k, (_, c) in expected.items()) > 60 and expected[9007][1] == 9000


def test_no_shingle_is_frequent_or_all_are(spark, monkeypatch):
    """What counts as frequent changes nothing that is found."""
    texts = groups(22)
    expected = want(texts)
    for start, most in ((1, 10**6), (8, 0), (3, 50)):
        monkeypatch.setattr(metric_join, "FREQUENT_FROM", start)
        monkeypatch.setattr(metric_join, "FREQUENT_MOST", most)
        assert found(spark, texts) == expected


def test_large_groups_of_copies_are_linked_to_pivots(spark, monkeypatch):
    """Near copies of one text cost about one distance each, not one per pair."""
    asked, measure = [], metric_join._distances
    monkeypatch.setattr(metric_join, "_distances", lambda pairs, *rest: asked.append(pairs.count()) or measure(pairs, *rest))
    r, base = random.Random(23), [f"b{i}" for i in range(400)]
    texts = {d: " ".join(edited(r, base, 0.0025)) for d in range(300)} | {300 + d: " ".join(base) for d in range(300)}
    assert {c for _, c in found(spark, texts).values()} == {0} and sum(asked) <= 3 * len(texts)


def test_awkward_rows(spark):
    rows = [*documents(seed=24, n=50), (None, "w1 w2 w3 w4 w5 w6", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [rows[3], (3, "w1 w2 w3 w4 w5 w6", "en", None, None, None, None, None), (700, "w1 w2 w3 w4 w5 W6", None, None, None, None, None, None)]
    got = metric_join.join(frame(spark, rows))
    assert got.columns == ["key", "n", "component"] and got.count() == len(rows)
    assert {r["component"] for r in got.where("key is null").collect()} == {None}
    blank = [r["component"] for r in got.where("n = 0 and key is not null").collect()]
    assert sorted(blank) == sorted(k for k, t, *_ in rows if k is not None and not plain(t)) and blank
    assert metric_join.join(frame(spark, [])).count() == 0
    words = spark.createDataFrame([("b", "One two"), ("a", "one  two"), ("c", "one two three four five six"), ("d", "ONE two three four five six")], "doc_id string, text string")
    assert {(r["key"], r["n"], r["component"]) for r in metric_join.join(words).collect()} == {("a", 1, "a"), ("b", 1, "a"), ("c", 2, "c"), ("d", 2, "c")}


def test_first_shingles():
    """Two sets that link share one of their first shingles, the shorter one of its first ones."""
    r = random.Random(25)
    for _ in range(2000):
        percent, size = r.choice([50, 80, 95]), r.randint(1, 60)
        x = set(r.sample(range(100), size))
        y = (x - set(r.sample(sorted(x), r.randint(0, len(x) // 3)))) | set(r.sample(range(100), r.randint(0, 6)))
        if y and 100 * len(x & y) >= percent * len(x | y):
            short, long_ = sorted((x, y), key=len)
            assert set(sorted(short)[:metric_join.first_of_shorter(len(short), percent)]) & set(sorted(long_)[:metric_join.first_of(len(long_), percent)])


def test_families_of_edited_copies_meet_once(spark, monkeypatch):
    """Copies with edits share dozens of first shingles: they are met once, not under each, and those with too many edits not at all."""
    kept, store = {}, metric_join.stored
    monkeypatch.setattr(metric_join, "stored", lambda df, name: kept.setdefault(name, []).append(out := store(df, name)) or out)
    r, base = random.Random(26), [f"b{i}" for i in range(400)]
    texts = {0: " ".join(base)} | {d: " ".join(edited(r, base, r.uniform(0.005, 0.08))) for d in range(1, 250)}
    expected = want(texts)
    assert found(spark, texts) == expected
    linked = sum(c == 0 for _, c in expected.values())
    assert 50 < linked < 200
    met = kept["large-regions"][0]
    assert met.count() == met.select("key").distinct().count() <= 1.5 * linked
    assert sum(m.count() for m in kept.get("met", [])) <= 20 * len(texts)
