"""Quality rules against a plain version, and the order of the cascade."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetscope.llm import quality

from .cases import documents, frame, words


def plain(text):
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    repeat = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(repeat)


def verdict(m):
    n, chars, symbols, lines, dup, repeat = m
    base = n < 50 or 100 * repeat > 50 * n
    return base, not (base or 5 * symbols > n or 10 * dup > 4 * lines or chars < 2 * n or chars > 15 * n)


@pytest.fixture(scope="module")
def rows():
    more = [(100, "ab " * 70_000, "en", "a", 1, "", "", ""), (101, "w1 # " * 60, "en", "a", 1, "", "", ""), (102, " ".join(f"u{i}" for i in range(60)), None, None, None, None, None, None)]
    return documents() + more + more[-1:]


def test_measures_and_verdict(spark, rows):
    df = frame(spark, rows).withColumn("kept", F.lit("clash"))
    names = list(quality.MEASURES)
    got = sorted((r["doc_id"], *(r[n] for n in names), r["base_failed"], r["kept"]) for r in quality.judge(df, rules=quality.RULES).collect())
    assert got == sorted((r[0], *plain(r[1]), *verdict(plain(r[1]))) for r in rows)


def test_upper_bits_path_equals_whole_hash_path(spark):
    text = " ".join(["a b c d"] * 3 + ["e f g"] + ["b c d"] * 2)
    assert quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), rules=quality.RULES).first()["n_repeat_words"] == plain(text)[5]


def test_clean_keeps_rows_and_columns(spark, rows):
    df = frame(spark, rows)
    out = quality.clean(df)
    assert out.columns == df.columns
    assert sorted(r[0] for r in out.collect()) == sorted(r[0] for r in rows if verdict(plain(r[1]))[1])


def test_order_rules(spark):
    df = spark.createDataFrame([("# " * 80,)] * 40 + [(" ".join(f"x{i}" for i in range(80)),)] * 10, "text string")
    order = quality.order_rules(df)
    assert set(order) == set(quality.RULES)
    rejecting = {"symbols", "repetitive", "odd_words"}
    assert {r.name for r in order[:3]} == rejecting  # rules that reject nothing come last
    assert quality.order_rules(df.limit(0)) == quality.RULES


def test_empty(spark):
    empty = frame(spark, [])
    assert quality.judge(empty).count() == 0 and quality.clean(empty).count() == 0
