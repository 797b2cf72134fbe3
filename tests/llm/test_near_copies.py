"""Families of near copies against the exact five-word similarity of all pairs."""

import random
from itertools import combinations

from fleetscope.llm import simhash

from .cases import WORD, documents

SCHEMA = "doc_id long, text string"


def plain(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def families(texts):
    """Least key of each key's family over all pairs, and the similarity of those that share a shingle."""
    sets, where, root, similar = {k: plain(t) for k, t in texts.items()}, {}, {k: k for k in texts}, {}
    for k, s in sets.items():
        for x in s or {()}:
            where.setdefault(x, []).append(k)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in {p for ks in where.values() for p in combinations(sorted(ks), 2)}:
        both, whole = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        similar[a, b] = both / whole if whole else 1
        if 5 * both >= 4 * whole:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}, similar


def found(spark, texts):
    return {r["key"]: r["component"] for r in simhash.families(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()}


def test_copies_that_share_a_long_passage(spark):
    """Texts of a common passage and 60 words of their own, each with one near copy: a few dozen lie under any one key."""
    r, passage, texts = random.Random(5), [f"p{i}" for i in range(300)], {}
    for d in range(150):
        w = [f"w{r.randrange(5000)}" for _ in range(60)]
        near = list(w)
        for i in r.sample(range(60), 4):
            near[i] = "new"
        texts |= {d: " ".join(w[:30] + passage + w[30:]), 1000 - d: " ".join(near[:30] + passage + near[30:])}
    want, _ = families(texts)
    got = found(spark, texts)
    assert got == want and sum(k != v for k, v in want.items()) >= 150


def test_only_exact_similarity_decides(spark):
    """Pairs on both sides of 0.8, down to one shingle; awkward texts; a chain whose ends are not alike."""
    r, texts = random.Random(6), {k: t for k, t, *_ in documents(seed=4, n=80)}
    for n in range(100, 400, 3):
        w = [f"w{r.randrange(5000)}" for _ in range(n)]
        near = list(w)
        for i in r.sample(range(n), r.randint(n // 60, n // 30)):
            near[i] = "new"
        texts |= {n * 10: " ".join(w), n * 10 + 1: " ".join(near), n * 10 + 2: " ".join(near[r.randint(0, n // 4):]).upper()}
    w = [f"c{i}" for i in range(204)]
    texts |= {9000 + i: " ".join(w[15 * i:] + [f"d{j}" for j in range(15 * i)]) for i in range(8)}
    want, similar = families(texts)
    for low, high in ((0.7, 0.8), (0.8, 0.85), (0.85, 0.9)):
        assert sum(low <= x < high for x in similar.values()) >= 10
    assert found(spark, texts) == want and similar[9000, 9007] < 0.8 and want[9007] == 9000


def test_large_groups_list_no_pairs(spark, monkeypatch):
    """Near copies of one text are compared with one of them, not with each other."""
    r, asked, alike = random.Random(7), [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, *rest: asked.append(pairs.count()) or alike(pairs, *rest))
    w = [f"w{i}" for i in range(300)]
    texts = {d: " ".join(x if i != at else "new" for i, x in enumerate(w)) for d, at in enumerate(r.sample(range(300), 200))}
    assert set(found(spark, texts).values()) == {0} and sum(asked) <= 3 * len(texts)
