"""Matches against a plain edit distance over all places."""

import math
import random

from fleetscope.llm import decontaminate as D

from .cases import documents, frame


def distance(p, t):
    """Least edit distance between p and any part of t."""
    prev = [0] * (len(t) + 1)
    for i, w in enumerate(p, 1):
        cur = [i]
        for j, x in enumerate(t, 1):
            cur.append(min(prev[j - 1] + (w != x), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_myers():
    r = random.Random(1)
    for _ in range(300):
        p, t = ([r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(a, 70))] for a in (1, 0))
        assert D.myers(p, t)[0] == distance(p, t)


def items(rows):
    r = random.Random(2)
    texts = [x[1].split() for x in rows if x[1] and len(x[1].split()) > 60]
    out = []
    for i in range(12):
        w = r.choice(texts)
        a = r.randrange(len(w) - 30)
        part = w[a:a + r.randint(8, 30)]
        for _ in range(r.randint(0, math.floor(0.3 * len(part)))):
            k = r.randrange(len(part))
            part[k:k + 1] = r.choice([[], ["new"], [part[k], "more"]])
        out.append((i, " ".join(part).upper()))
    return out + [(20, None), (21, ""), (22, "w1"), (None, "w1 w2 w3 w4 w5 w6"), out[0]]


def test_matches_and_decontaminate(spark):
    rows = documents()
    bench = items(rows)
    want = {}
    for d, text, *_ in rows:
        for k, t in bench:
            p = D.plain(t)
            if k is not None and len(p) >= D.MIN_WORDS and text and (e := distance(p, D.plain(text))) <= math.floor(D.RATE * len(p)):
                want[d, k] = e
    assert len(want) > 5
    docs, table = frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    got = D.matches(docs, table).collect()
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == want and len(got) == len(want)
    for r in got:
        part = D.plain(dict((x[0], x[1]) for x in rows)[r["doc_id"]])[r["first_word"]:r["end_word"]]
        assert distance(part, D.plain(dict(bench)[r["item_id"]])) <= r["distance"]
    clean = D.decontaminate(docs, table)
    assert clean.columns == docs.columns
    assert sorted(r[0] for r in clean.collect()) == sorted({r[0] for r in rows} - {d for d, _ in want})


def test_blocks_give_the_same(spark):
    rows = documents()
    table = spark.createDataFrame(items(rows), "item_id long, text string")
    parts = list(D.blocks(table, block_bytes=300))
    assert len(parts) > 2 and sorted(x for p in parts for x in p) == next(D.blocks(table))


def test_empty(spark):
    docs, none = frame(spark), spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs, none).count() == 0 and D.decontaminate(docs, none).count() == docs.count()
    assert D.matches(frame(spark, []), none).count() == 0
