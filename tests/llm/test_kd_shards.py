"""Balance, groups, numbering and the shape of the tree."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fleetscope.llm import kd_shards as K

from .cases import crc, documents, frame

DIMS = ["n_chars", "doc_id", "source", "lang"]


def placed(spark, rows, shards, dims=DIMS):
    return K.shard(frame(spark, rows), shards, dims).collect()


def sizes(rows):
    return Counter((r[0], len((r[1] or "").encode()) + 16, crc((r[1] or "").encode())) for r in rows)


@pytest.mark.parametrize("shards", [1, 7, 16])
def test_shards(spark, shards):
    rows = documents(n=400)[:-1] + documents()[:3]
    got = placed(spark, rows, shards)
    assert Counter((r["key"], r["size"], r["text_crc32"]) for r in got) == sizes(rows)
    total, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert sorted(total) == list(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    weight = {(c, s): s * sum(m for (_, t, x), m in sizes(rows).items() if (x, t) == (c, s)) for _, s, c in sizes(rows)}
    limit = max(max(s for _, s, _ in sizes(rows)), sum(total.values()) // (10 * shards))
    assert all(len(v) == 1 for g, v in groups.items() if weight[g] <= limit)
    assert max(total.values()) - min(total.values()) <= 2 * limit


def test_hot_group_is_spread(spark):
    rows = [(i, "same text " * 5 if i % 3 == 0 else f"text {i} " * 5, "en", "hot", 50, None, None, None) for i in range(3000)]
    got = placed(spark, rows, 10)
    total = Counter()
    for r in got:
        total[r["shard"]] += r["size"]
    mean = sum(total.values()) / 10
    assert len(got) == 3000 and max(total.values()) < 1.1 * mean and min(total.values()) > 0.9 * mean


def test_ties_and_nulls(spark):
    rows = [(None, None, None, None, None, None, None, None)] * 50 + [(5, "x", "en", "a", 1, None, None, None)] * 50
    got = placed(spark, rows, 4)
    assert len(got) == 100 and Counter(r["size"] for r in got) == {16: 50, 17: 50}
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted(set((r["shard"], r["slot"]) for r in got))


def test_empty(spark):
    assert placed(spark, [], 4) == []


def test_cut_follows_the_widest_dimension(spark):
    points = spark.createDataFrame([(i % 2, i, i, 1) for i in range(1000)], "_d0 long, _d1 long, _tie long, _w long")
    root = K.tree(points, 2, 2, 1000)
    side = points.groupBy("_d0").agg(F.collect_set(K._place(root)).alias("at")).collect()
    assert root.dim == 0 and {r["_d0"]: r["at"] for r in side} == {0: [0], 1: [1]}
    root = K.tree(points.selectExpr("0L _d0", "_d1", "_tie", "_w"), 2, 2, 1000)
    assert root.dim == 1 and abs(root.value - 500) <= 1


def test_write(spark, tmp_path):
    df = frame(spark)
    where = K.shard(df, 3, DIMS)
    K.write_shards(df, where, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == {(r["key"], r["shard"]) for r in where.collect()}
