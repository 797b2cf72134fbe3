"""Fingerprints, links and classes against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fleetscope.llm import simhash
from fleetscope.llm.components import components

from .cases import WORD, documents, frame


def plain(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps: dict) -> dict:
    """Least key of the component of each key."""
    keys, root = sorted(fps), {}
    for k in keys:
        near = {root[o] for o in root if (fps[o] ^ fps[k]).bit_count() <= 2} | {k}
        m = min(near)
        root[k] = m
        for o in root:
            if root[o] in near:
                root[o] = m
    return root


def test_classes(spark):
    rows = documents()
    fps = {r[0]: plain(r[1]) for r in rows}
    got = {r["key"]: (r["fp"] & (1 << 64) - 1, r["component"]) for r in simhash.classes(frame(spark, rows)).collect()}
    want = classes(fps)
    assert got == {k: (fps[k], want[k]) for k in fps}


def test_links_of_all_distances(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = {x for b in base for x in [b, *(b ^ sum(1 << i for i in r.sample(range(64), n)) for n in (1, 2, 2, 3, 4))]} | {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    for a, b in found.collect():
        assert 0 < ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    root = {r["node"]: r["root"] for r in components(found).collect()}
    want = classes({x: int(np.int64(x).view(np.uint64)) for x in signed})
    assert {x: root.get(x, x) for x in signed} == want


def test_dense_group_gives_few_links(spark):
    fps = [(0,)] + [(1 << i,) for i in range(62)] + [(1 << i | 1 << j,) for i in range(30) for j in range(i)]
    assert simhash.links(spark.createDataFrame(fps, "fp long")).count() <= 65 * len(fps)


def test_components_of_a_long_path(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(500, 499), (7, 7), (None, 3)], "a long, b long"))
    got = {r["node"]: r["root"] for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 499}


def test_keep_one(spark):
    rows = documents()
    df = frame(spark, rows + [rows[-1]] + [(None, "alone", None, None, None, None, None, None)])
    out = simhash.keep_one(df)
    want = classes({r[0]: plain(r[1]) for r in rows})
    assert out.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out.collect()) == sorted([(False, k) for k, v in want.items() if k == v]) + [(True, None)]


def test_empty(spark):
    assert simhash.classes(frame(spark, [])).count() == 0 and simhash.keep_one(frame(spark, [])).count() == 0


def test_copies_go_and_others_stay(spark):
    """Copies in other case go, near copies where the fingerprints say so; texts that share half of their words stay."""
    r, rows = random.Random(8), []
    for d in range(0, 120, 4):
        w = [f"w{r.randrange(5000)}" for _ in range(300)]
        near = [x if i % 300 else "new" for i, x in enumerate(w)]
        half = w[:150] + [f"w{r.randrange(5000)}" for _ in range(150)]
        rows += [(d, " ".join(w)), (d + 1, " ".join(near)), (d + 2, " ".join(w).upper()), (d + 3, " ".join(half))]
    kept = {x[0] for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(d in kept and d + 3 in kept and d + 2 not in kept for d in range(0, 120, 4))
    want = classes({d: plain(t) for d, t in rows})
    assert kept == {d for d, c in want.items() if d == c} and sum(d % 4 == 1 for d in kept) < 15
