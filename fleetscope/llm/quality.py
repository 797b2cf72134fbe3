"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule is a test on one measure of the text. `order_rules` runs every rule on a bounded sample, takes its
time per row as cost and the share of rejected rows as selectivity, and sorts the rules by rejections per unit
of cost. `judge` and `clean` then evaluate them in that order inside one CASE: the first rule that rejects a
row ends the work on it, and a measure that no rule reaches is not computed. The order decides the cost only,
never the verdict.

Null and empty texts have no words and fail `short`. Repeated rows are judged one by one, extra columns are
kept, an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .exprs import SPACES, let, words

SYMBOLS = "#*$%&|<>"


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)


def _bare(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def word_chars(text: Column, w: Column) -> Column:
    return F.length(_bare(text)).cast("long")


def n_symbols(text: Column, w: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")


def n_words(text: Column, w: Column) -> Column:
    return F.size(w).cast("long")


def n_lines(text: Column, w: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column, w: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(text: Column, w: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by the 64-bit hash of their words. Texts without equal windows stop there. In the
    others, the upper bits of the hash and the position make one number per window; once these are sorted,
    equal windows are neighbours. Where upper bits agree but hashes don't, or positions need more bits, whole
    hashes are sorted instead.
    """
    bits = 24
    low = (1 << bits) - 1

    def neighbours(s: Column, pair: Callable[[Column, Column], Column]) -> Column:
        return F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), pair)

    def covered(p: Column) -> Column:
        steps = neighbours(p, lambda a, b: F.least(b - a, F.lit(3).cast("long")))
        return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.lit(3).cast("long"), lambda s, x: s + x))

    def positions(pairs: Column) -> Column:
        return F.sort_array(F.array_distinct(F.flatten(pairs)))

    def by_hash(h: Column) -> Column:
        pairs = lambda s: neighbours(s, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        return let(order, lambda s: let(positions(F.filter(pairs(s), lambda x: x.isNotNull())), covered))

    def by_upper_bits(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
        pair = lambda a, b: F.when(a.bitwiseXOR(b) <= low, F.array(a.bitwiseAND(F.lit(low)), b.bitwiseAND(F.lit(low))))
        same = lambda x: F.get(h, F.get(x, F.lit(0)).cast("int")) == F.get(h, F.get(x, F.lit(1)).cast("int"))
        return let(order, lambda s: let(F.filter(neighbours(s, lambda a, b: F.when((a.bitwiseXOR(b) >= 0), pair(a, b))), lambda x: x.isNotNull()),
                                        lambda p: F.when(F.forall(p, same), let(positions(p), covered)).otherwise(by_hash(h))))

    def repeats(h: Column) -> Column:
        return (F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                .when(F.size(h) > low, by_hash(h)).otherwise(by_upper_bits(h)))

    at = F.get
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(at(w, i), at(w, i + 1), at(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(windows, repeats))


MEASURES = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_lines": n_lines,
            "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}

#: Gives the measure of that name for the row at hand.
Measure = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measure], Column]


BASE = (
    Rule("short", lambda m: m("n_words") < 50),
    Rule("repetitive", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)

#: Base rules and: a symbol for every five words or more, over 40 % repeated lines, odd mean word length.
RULES = (
    *BASE,
    Rule("symbols", lambda m: 5 * m("n_symbols") > m("n_words")),
    Rule("same_lines", lambda m: 10 * m("n_dup_lines") > 4 * m("n_lines")),
    Rule("odd_words", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
)


def _reason(rules: tuple[Rule, ...], m: Measure) -> Column:
    out = None
    for r in rules:
        out = F.when(r.rejects(m), r.name) if out is None else out.when(r.rejects(m), r.name)
    return F.lit(None).cast("string") if out is None else out


def rejected_by(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Name of the first rule, in the order given, that rejects the text; null if none does."""
    return let(words(text), lambda w: _reason(rules, lambda name: MEASURES[name](text, w)))


def order_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 500) -> tuple[Rule, ...]:
    """rules by falling rejections per second, as seen on at most sample_rows rows.

    Rules that reject nothing on the sample come last, cheapest first.
    """
    spark = df.sparkSession
    sample = [r[0] for r in df.select(text).limit(sample_rows).collect()]
    if not sample:
        return rules
    held = spark.createDataFrame([(x,) for x in sample], "text string").coalesce(1)
    seen = []
    for r in rules:
        count = held.agg(F.count_if(rejected_by(F.col("text"), (r,)).isNotNull()).alias("n"))
        count.collect()  # compiles the plan
        began = time.perf_counter()
        n = count.collect()[0]["n"]
        seen.append((n / max(time.perf_counter() - began, 1e-6), -(time.perf_counter() - began), r))
    return tuple(r for _, _, r in sorted(seen, key=lambda x: x[:2], reverse=True))


def clean(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rows that no rule rejects, all columns as they were."""
    return df.where(rejected_by(F.col(text), rules or order_rules(df, text)).isNull())


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Every row with all measures, base_failed and kept; columns of these names in df are replaced."""
    rules = rules or order_rules(df, text)
    names = list(MEASURES)
    measures = let(words(F.col(text)), lambda w: F.struct(*[MEASURES[n](F.col(text), w).alias(n) for n in names]))
    rest = [c for c in df.columns if c.lower() not in {*names, "base_failed", "kept", "_m"}]
    out = df.select(*rest, measures.alias("_m"))
    m = lambda name: F.col(f"_m.{name}")
    return out.select(*rest, *[m(n).alias(n) for n in names], _reason(BASE, m).isNotNull().alias("base_failed"),
                      _reason(rules, m).isNull().alias("kept"))
