"""Removed words against a plain scan over all windows."""

import random

import numpy as np
import pytest

from fleetscope.llm import debruijn as B

from .cases import digest, documents, frame, words


def plain(rows, k):
    first, w = {}, {d: words(t) for d, t in rows if d is not None}
    for d in sorted(w):
        for i in range(len(w[d]) - k + 1):
            first.setdefault(tuple(w[d][i:i + k]), (d, i))
    out = {}
    for d, x in w.items():
        gone = {j for i in range(len(x) - k + 1) if first[tuple(x[i:i + k])] != (d, i) for j in range(i, i + k)}
        out[d] = len(x), len(gone), digest([y for i, y in enumerate(x) if i not in gone])
    return out


def passages(seed):
    """Texts that share passages of many lengths, repeat their own, and hold periodic runs."""
    r, out = random.Random(seed), []
    for d in range(150):
        parts = [r.choice(["p0", "p1", "q"]) if r.random() < 0.5 else f"w{r.randrange(1000)}" for _ in range(r.randint(0, 80))]
        if r.random() < 0.4:
            parts += ["x"] * r.randint(0, 60) + [f"y{i}" for i in range(5, 5 + r.randint(0, 50))]
        if r.random() < 0.2:
            parts += ["a", "b"] * r.randint(0, 40)
        if out and r.random() < 0.4:
            o = r.choice(out)[1].split()
            a = r.randrange(len(o) + 1)
            parts += o[a:a + r.randint(10, 60)]
        out.append((d, " ".join(parts)))
    return out


@pytest.mark.parametrize("k, gram", [(20, 5), (6, 3)])
def test_digests(spark, k, gram):
    rows = passages(k)
    got = B.digests(spark.createDataFrame(rows, "doc_id long, text string"), k=k, gram=gram).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == plain(rows, k)


@pytest.mark.parametrize("size", [1, 3000])
def test_batches_flushed_by_bytes(spark, monkeypatch, size):
    monkeypatch.setattr(B, "FLUSH_BYTES", size)
    rows = passages(3) + [(900, "long " + " ".join(f"v{i % 997}" for i in range(200_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    known = spark.sparkContext.broadcast(B.bit_map(B.repeated_minimizers(df.select("doc_id", "text"), 20, 5)))
    found = B.occurrences(df, known, 20, 5)
    pairs = found.groupBy("a", "s").count().count()
    assert found.where("c > 0").count() > pairs and found.selectExpr("sum(c) = count(*)").first()[0]
    got = B.digests(df).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == plain(rows, 20)


def test_awkward_documents(spark):
    rows = documents() + [(200, "z " * 20_000, None, None, None, None, None, None), (201, "z " * 30, None, None, None, None, None, None)]
    got = B.digests(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == plain([r[:2] for r in rows], 20)


def test_texts_null_keys_and_repeated_rows(spark):
    text = " ".join(f"u{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, "new " + text), (None, text)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in B.deduplicate(df).collect()))
    assert got == [(0, text, 0), (1, text, 0), (1, text, 0), (2, "new", 40)]


def test_empty(spark):
    assert B.digests(frame(spark, [])).count() == 0


def test_least():
    r = np.random.default_rng(1)
    for _ in range(100):
        v = r.integers(0, 5, r.integers(1, 40)).astype(np.uint64)
        n = int(r.integers(1, len(v) + 1))
        assert B.least(v, n).tolist() == [i + int(np.argmin(v[i:i + n])) for i in range(len(v) - n + 1)]
