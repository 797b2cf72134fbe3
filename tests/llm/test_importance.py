"""Importance resampling against a plain version that uses no bytes, tables or seeds."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from fleetscope.llm import importance

from .cases import documents, frame

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return w, [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, n, buckets, percent=10, least=20, seed=2024):
    of = lambda text: [zlib.crc32(f.encode()) % buckets for f in features(text, n)[1]]
    s, t = Counter(b for _, x in docs for b in of(x)), Counter(b for x in target for b in of(x))
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out, able = [], []
    for k, x in docs:
        bs = of(x)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(features(x, n)[0]), len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if out[-1][1] >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:len(able) * percent // 100], 1):
        r[5] = i
    return sorted(map(tuple, out), key=str)


def got(spark, rows, target, **how):
    out = importance.resample(frame(spark, rows), spark.createDataFrame([(x,) for x in target], "body string"), target_text="body", **how)
    assert out.columns == ["key", "n_words", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, out.collect()), key=str)


TARGET = ["W1 w2, w3 Straße", None, "", "w1-w2 ÉTÉ été 日本語 w9 end. w7", "w1 w2 w3"]


@pytest.mark.parametrize("n, buckets", [(1, 10_000), (3, 50), (2, 7)])
def test_against_plain(spark, n, buckets):
    rows = [*documents(seed=8, n=80), (None, "w1 w2 w3 " * 9, None, None, None, None, None, None)]
    rows.append(rows[3])
    docs = [(r[0], r[1]) for r in rows]
    assert got(spark, rows, TARGET, n=n, buckets=buckets, percent=30) == plain(docs, TARGET, n, buckets, percent=30)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_pieces(monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    for text in (None, "", "--", "A b,C\x00d éÉ 1_2", " ".join(f"W{i}" for i in range(50)) + "!"):
        w, all_runs = features(text, 4)
        assert [x for p in importance.pieces(text) for x in p] == [x.encode() for x in w]
        assert Counter(c for runs in importance.longer(importance.pieces(text), 4) for c in runs) == Counter(
            zlib.crc32(f.encode()) for f in all_runs if " " in f)


def test_ties_nothing_and_no_target(spark):
    same = [(i, "w1 " * 20, None, None, None, None, None, None) for i in (5, 5, 5)]
    assert [r[5] for r in got(spark, same, [], percent=100)] == [1, 2, 3]
    assert got(spark, [], TARGET) == [] and got(spark, [], []) == []
    short = [(1, "one two", None, None, None, None, None, None), (2, None, None, None, None, None, None, None)]
    assert [r[5] for r in got(spark, short, TARGET, percent=100)] == [None, None]


def test_a_very_long_text(spark):
    rows = [(1, "Ab cd " * 2_000_000, None, None, None, None, None, None)]
    assert got(spark, rows, ["ab"])[0][1:3] == (4_000_000, 4_000_000)
