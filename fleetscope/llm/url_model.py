"""URL filter: rules first, then two character language models.

Each of the two models, one of accepted and one of rejected URLs, is a variable-order Markov model: the
probability of a character is the Witten-Bell mixture over all contexts up to `order` characters, so as many
characters of context count as have been seen. A URL's score is the difference of its log-likelihoods under both,
divided by its length; URLs that score below a threshold are blocked. The threshold is the middle of the scores between which the
sum of both error rates is least.

Labels: `terms` name what is rejected; a URL with one of them as a part of its host is a rejected example, every other
one an accepted example. Every distinct URL counts in the models and in the threshold: URLs are dealt to two folds by their hash,
each fold is scored by the models of the other one, all these scores give the threshold, and the models that judge are
those of both folds. Scores stay in tables; only sums over them and the threshold reach the driver. `sample` lets only so many
URLs of each label, those with the least hashes, decide the threshold; by default all do.

Grams are counted by Spark. Counts of up to `BROADCAST_GRAMS` grams are broadcast as two models. More of them stay a
table: then the windows of `order` + 1 characters of the URLs to judge are joined, once each, with the counts of their
ends, which gives the same scores.

Null URLs and those without :// have an empty host and path; an empty host and path scores zero and is allowed. Without
examples of both labels everything is allowed. Repeated rows are judged one by one, extra columns are kept.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from .exprs import stored

ORDER = 4
#: Grams, at most, whose counts are sent to every executor. More are joined; the scores are the same.
BROADCAST_GRAMS = 200_000
#: Words of unwanted hosts.
TERMS = ("ads", "adult", "bets", "bet", "casino", "pills", "poker", "porn", "spam", "xxx")
START, END = "\x02", "\x03"
SYMBOLS = 256

Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ://, up to / ? # or the end, with A-Z in lower case; then up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule, written host + path, that fits; null if none does."""
    fits = [(F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), f"{h}{p}"))
            for _, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def labelled(hosts: DataFrame, terms: tuple[str, ...] = TERMS) -> Column:
    """Whether a word of the host is one of the terms."""
    return F.arrays_overlap(F.split(F.col("_host"), r"[^a-z0-9]+"), F.array(*[F.lit(t) for t in terms]))


class Model:
    """Witten-Bell mixture from counts of grams (context and character) of one to order + 1 characters."""

    def __init__(self, counts: dict[str, int]):
        total, kinds = defaultdict(int), defaultdict(int)
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        self.back = {c: math.log(kinds[c] / (kinds[c] + total[c])) for c in total}
        self.log = {}
        for g in sorted(counts, key=len):
            c = g[:-1]
            lower = self.log[g[1:]] if len(g) > 1 else -math.log(SYMBOLS)
            self.log[g] = math.log((counts[g] + kinds[c] * math.exp(lower)) / (total[c] + kinds[c]))

    def score(self, text: str, order: int) -> float:
        """Log-likelihood of the characters of text and its end."""
        s, out = START * order + text + END, 0.0
        log, back = self.log, self.back
        for i in range(order, len(s)):
            for a in range(i - order, i + 1):
                if (p := log.get(s[a:i + 1])) is not None:
                    out += p
                    break
                out += back.get(s[a:i], 0.0)
            else:
                out -= math.log(SYMBOLS)
        return out


def _threshold(scores: DataFrame) -> float:
    """Where the share of good below and of bad above it are least in sum, at most zero; scores has score and bad.

    Distinct scores are put into ranges; what lies before a range comes from the ranges' sums.
    """
    n = [F.sum((F.col("bad") == b).cast("long")).alias(c) for b, c in ((False, "good"), (True, "bads"))]
    by = scores.select(F.round("score", 9).alias("score"), "bad").groupBy("score").agg(*n)
    by = stored(by.repartitionByRange("score").withColumn("_part", F.spark_partition_id()), "url-scores")
    ends = by.groupBy("_part").agg(F.min("score").alias("_first"), F.sum("good").alias("_good"), F.sum("bads").alias("_bads"))
    before, w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_part")  # a row per range
    ends = ends.select("_part", F.lead("_first").over(w).alias("_next"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_good", "_bads")])
    inside = Window.partitionBy("_part").orderBy("score")
    at = by.withColumns({c: F.sum(c).over(inside) for c in ("good", "bads")} | {"after": F.lead("score").over(inside)}).join(ends, "_part")
    whole = by.agg(F.sum("good").alias("good"), F.sum("bads").alias("bads"), F.min("score").alias("least")).first()
    errors = 1 + (F.col("good") + F.col("_good")) / F.lit(whole.good) - (F.col("bads") + F.col("_bads")) / F.lit(whole.bads)
    after = F.coalesce("after", "_next", F.col("score") + 1)
    best = at.select(F.min(F.struct(F.round(errors, 12).alias("errors"), ((F.col("score") + after) / 2).alias("at"))).alias("best")).first().best
    return min(min((1.0, whole.least - 1), (best.errors, best["at"]))[1], 0.0)


class Calibrated:
    """What has a threshold."""

    threshold = -math.inf


class Filter(Calibrated):
    """Both models and the threshold."""

    def __init__(self, accepted: Model, rejected: Model, order: int):
        self.accepted, self.rejected, self.order = accepted, rejected, order

    def score(self, text: str) -> float:
        if not text:
            return 0.0
        return (self.accepted.score(text, self.order) - self.rejected.score(text, self.order)) / (len(text) + 1)


class TableFilter(Calibrated):
    """Both models as a table of counts (g, good, bad), and the threshold."""

    def __init__(self, counts: DataFrame, order: int):
        self.counts, self.order = counts, order

    def scores(self, texts: DataFrame) -> DataFrame:
        """t and score of each distinct text t, which must not be null."""
        n = self.order + 1
        s = F.concat(F.lit(START * self.order), F.col("t"), F.lit(END))
        windows = F.transform(F.sequence(F.lit(n), F.length("s")), lambda i: F.substring(F.col("s"), i - self.order, n))
        each = texts.where("t != ''").select("t").distinct().select("t", s.alias("s")).select("t", F.explode(windows).alias("w"))
        found = each.join(self._ratios(stored(each.select("w").distinct(), "url-windows")), "w").groupBy("t").agg(F.sum("ratio").alias("sum"))
        return found.select("t", (F.col("sum") / (F.length("t") + 1)).alias("score"))

    def _ratios(self, windows: DataFrame) -> DataFrame:
        """w and the difference of the log-likelihoods of its last character after the others."""
        length = F.length("g")
        contexts = self.counts.groupBy(F.substring(F.col("g"), F.lit(1), length - 1).alias("c")).agg(
            *[F.sum(n).alias(f"{n}_all") for n in ("good", "bad")], *[F.sum((F.col(n) > 0).cast("long")).alias(f"{n}_kinds") for n in ("good", "bad")])
        contexts, lower = stored(contexts, "url-contexts"), None
        for k in range(1, self.order + 2):
            grams = windows.select(F.substring("w", self.order + 2 - k, k).alias("g")).distinct().withColumn("c", F.substring("g", 1, k - 1))
            grams = grams.join(self.counts.where(length == k), "g", "left").join(contexts.where(F.length("c") == k - 1), "c", "left")
            if lower is None:
                grams = grams.withColumns({f"{n}_lower": F.lit(1 / SYMBOLS) for n in ("good", "bad")})
            else:
                grams = grams.join(lower, F.substring("g", 2, k - 1) == F.col("end")).drop("end")
            p = [F.when(F.col(f"{n}_all") > 0, (F.coalesce(n, F.lit(0)) + F.col(f"{n}_kinds") * F.col(f"{n}_lower")) / (F.col(f"{n}_all") + F.col(f"{n}_kinds")))
                 .otherwise(F.col(f"{n}_lower")) for n in ("good", "bad")]
            lower = stored(grams.select(F.col("g").alias("end"), p[0].alias("good_lower"), p[1].alias("bad_lower")), "url-probabilities")
        return lower.select(F.col("end").alias("w"), (F.ln("good_lower") - F.ln("bad_lower")).alias("ratio"))


SIDES = [(f"{name}{fold}", bad, fold) for name, bad in (("good", False), ("bad", True)) for fold in (0, 1)]


def _counts(texts: DataFrame, order: int) -> DataFrame:
    """How often each gram occurs in the column t of good and of bad texts of each fold."""
    s = F.concat(F.lit(START * order), F.col("t"), F.lit(END))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda n: F.transform(
        F.sequence(F.lit(order + 1), F.length("s")), lambda i: F.substring(F.col("s"), i - n + 1, n))))
    return texts.select("bad", "fold", s.alias("s")).select("bad", "fold", F.explode(grams).alias("g")).groupBy("g").agg(
        *[F.sum(((F.col("bad") == bad) & (F.col("fold") == fold)).cast("long")).alias(c) for c, bad, fold in SIDES])


def train(pages: DataFrame, url: str = "url", terms: tuple[str, ...] = TERMS, order: int = ORDER, sample: int | None = None) -> Filter | TableFilter | None:
    """The filter learned from pages; None without two examples of each label."""
    host, path = host_and_path(F.col(url))
    seen = pages.select(host.alias("_host"), path.alias("_path")).where("_host != ''")
    seen = seen.select(labelled(seen, terms).alias("bad"), F.concat("_host", "_path").alias("t")).distinct()
    seen = stored(seen.withColumn("fold", F.pmod(F.xxhash64("t"), F.lit(2)).cast("int")), "url-examples")
    have = {r.bad: r["count"] for r in seen.groupBy("bad").count().collect()}
    if min(have.get(False, 0), have.get(True, 0)) < 2:
        return None
    asked = seen
    if sample is not None:
        few = [seen.where(F.col("bad") == bad).orderBy(F.xxhash64("t"), "t").limit(sample) for bad in (False, True)]
        asked = stored(few[0].unionByName(few[1]), "url-asked")
    counts = stored(_counts(seen, order), "url-grams")
    if counts.count() > BROADCAST_GRAMS:
        def table_of(*folds: int) -> TableFilter:
            sums = [sum((F.col(f"{c}{k}") for k in folds[1:]), F.col(f"{c}{folds[0]}")).alias(c) for c in ("good", "bad")]
            return TableFilter(counts.select("g", *sums).where("good + bad > 0"), order)

        found = [table_of(1 - k).scores(asked.where(F.col("fold") == k)) for k in (0, 1)]
        f = table_of(0, 1)
        f.threshold = _threshold(found[0].unionByName(found[1]).join(asked, "t"))
        return f
    rows = counts.toArrow()
    grams, n = rows.column("g").to_pylist(), {c: rows.column(c).to_pylist() for c, _, _ in SIDES}

    def model_of(*folds: int) -> Filter:
        return Filter(*[Model({g: sum(x) for g, *x in zip(grams, *[n[f"{c}{k}"] for k in folds]) if any(x)}) for c in ("good", "bad")], order)

    found = [_scored(asked.where(F.col("fold") == k).select("bad", "t"), model_of(1 - k), lambda b: b.column(1).to_pylist()) for k in (0, 1)]
    f = model_of(0, 1)
    f.threshold = _threshold(found[0].unionByName(found[1]))
    return f


def _scored(df: DataFrame, model: Filter, texts: Callable) -> DataFrame:
    """df with the score of the text that `texts` takes from each row of a batch."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        f = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f.score(t) for t in texts(b)], pa.float64())], names=[*b.schema.names, "score"])

    return df.mapInArrow(scored, df.select("*", F.lit(0.0).alias("score")).schema)


def judge(pages: DataFrame, rules: list[Rule], model: Filter | TableFilter | None, url: str = "url") -> DataFrame:
    """pages with host, path, rule, score and verdict; columns of these names are replaced."""
    host, path = host_and_path(F.col(url))
    own = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in pages.columns if c.lower() not in own or c == url]
    out = pages.select(*[F.col(c) for c in kept], host.alias("host"), path.alias("path"))
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.coalesce(*[F.when(F.col("rule") == f"{h}{p}", v) for v, h, p in rules], F.lit(None).cast("string"))
    if model is None:
        return out.withColumns({"score": F.lit(0.0), "verdict": F.coalesce(by_rule, F.lit("allow"))})
    verdict = F.coalesce(by_rule, F.when(F.col("score") < model.threshold, "block").otherwise("allow"))
    if isinstance(model, TableFilter):
        found = model.scores(out.select(F.concat("host", "path").alias("t"))).select(F.col("t").alias("_url_text"), "score")
        out = out.join(found, F.concat("host", "path") == F.col("_url_text"), "left").drop("_url_text")
        return out.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("verdict", verdict)
    at = len(kept)
    out = _scored(out, model, lambda b: [h.as_py() + p.as_py() for h, p in zip(b.column(at), b.column(at + 1))])
    return out.withColumn("verdict", verdict)
