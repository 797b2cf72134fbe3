"""Licence notices by a trained paragraph classifier (DataFrame and SQL functions, and Spark's own ML).

A paragraph is a line of a text. Paragraphs with a cue word (`CUES`) are classified by a multinomial logistic
regression, made sparse by an L1 penalty, over word n-grams of one to three words: into a licence family, `unknown`
(a notice of some other licence) or `none`. A prediction of a family holds if its probability reaches a threshold
calibrated on held-out notices and if the paragraph contains four fifths of the word pairs of one of the family's
templates; otherwise the notice is `unknown`.

The training rows are the templates with words left out and text around them, notices of made-up licences, and
plain text around cue words; their words of running text come from at most `sample` texts. So training has a
bounded size, and the model is one literal of a few thousand numbers in the plan: texts are classified in one
projection, without a shuffle.

Null and empty texts have no paragraphs. Repeated rows are judged one by one, extra columns are kept, an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .exprs import let, words

#: Short notices of each family.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "bsd-3-clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved."],
}
#: Notices of licences outside the families; {} is a made-up name.
OTHERS = ["Licensed under the {} License, version 1.", "Released under the {} License.", "This work is licensed under the {} Public License.", "Licensed under {} 3.0.",
          "Subject to the terms of the {} licence.", "Licensed under the {} License, Version 2.0."]
#: Paragraphs that are not notices but have a cue word.
PLAIN = ["{} the rights of {}", "{} license {}", "{} with permission {}", "{} licensed {}", "{} reserved {}", "{} copyright {}"]
CUES = r"(?i)\b(?:licen[cs]e|licen[cs]ed|rights reserved|copyright|permission|public domain|creative commons|source code)\b"

UNKNOWN, NONE = "unknown", "none"
SAMPLE = 200
CONTAINED = 0.8


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("licence"), F.lit("license")), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def _grams(t: Column, n: int) -> Column:
    """The distinct n-grams of the words t."""
    at = F.sequence(F.lit(1), F.size(t) - n + 1)
    return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.slice(t, i, n)))))


def features(text: Column) -> Column:
    return let(_terms(text), lambda t: F.concat(_grams(t, 1), _grams(t, 2), _grams(t, 3)))


def pairs(text: Column) -> Column:
    return let(_terms(text), lambda t: _grams(t, 2))


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    threshold: float


def examples(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Training rows (family, notice, held): a third of them held out for calibration."""
    spark = docs.sparkSession
    filler = docs.where(F.length(text) > 40).select(F.slice(words(F.col(text)), 1, 12).alias("w")).where("size(w) >= 8").limit(sample)
    filler = spark.createDataFrame([(i, r.w) for i, r in enumerate(filler.collect())] or [(0, ["text"] * 8)], "i int, w array<string>")  # sample rows at most
    lead, tail = F.array_join(F.slice("w", 1, 4), " "), F.array_join(F.slice("w", 5, 4), " ")
    known = spark.createDataFrame([(k, t) for k, v in TEMPLATES.items() for t in v], "family string, t string")
    told = known.select("family", "t", F.posexplode(F.split("t", " ")).alias("p", "_")).select(
        "family", F.explode(F.array("t", F.when(F.size(F.split("t", " ")) > 6, F.array_join(F.filter(F.split("t", " "), lambda x, i: i != F.col("p")), " ")))).alias("t"),
        F.col("p").alias("v")).where("t is not null")
    n = filler.count()
    around = told.join(F.broadcast(filler), F.pmod(F.xxhash64("t", "v"), F.lit(n)) == F.col("i"))
    rows = around.select("family", F.explode(F.array("t", F.concat_ws(" ", lead, "t"), F.concat_ws(" ", "t", tail))).alias("t"))
    name = lambda j: F.initcap(F.get("w", F.lit(j)))
    made = lambda kind, forms, a, b: filler.select(F.lit(kind).alias("family"), F.explode(F.array(*[F.concat_ws("", *[
        x for k, s in enumerate(p.split("{}")) for x in ((F.lit(s),) if not k else ((a, b)[(k - 1) % 2], F.lit(s)))]) for p in forms])).alias("t"))
    other = made(UNKNOWN, OTHERS, name(0), name(1))
    plain = made(NONE, PLAIN, lead, tail)
    rows = rows.unionByName(other).unionByName(plain)
    return rows.distinct().withColumn("held", F.pmod(F.xxhash64("t"), F.lit(3)) == 0)


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE, least_precision: float = 0.99) -> Model:
    """The classifier; its threshold is the least one at which held-out notices given a family have it with least_precision."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    classes = (*sorted(TEMPLATES), UNKNOWN, NONE)
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")) - 1
    rows = examples(docs, text, sample).select("t", "held", "family", label.cast("double").alias("label"), features(F.col("t")).alias("g")).cache()
    try:
        fit = rows.where("not held")
        sizes = fit.groupBy("family").agg((1000 / F.count("*")).alias("weight"))  # every class counts the same
        fit = fit.join(F.broadcast(sizes), "family")
        vector = CountVectorizer(inputCol="g", outputCol="features", minDF=3.0, vocabSize=4000, binary=True).fit(fit)
        lr = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=1.0, maxIter=50, standardization=False, weightCol="weight").fit(vector.transform(fit))
        table = lr.coefficientMatrix.toArray()
        weights = {g: tuple(round(float(x), 6) for x in table[:, i]) for i, g in enumerate(vector.vocabulary) if any(abs(x) > 1e-6 for x in table[:, i])}
        model = Model(classes, tuple(round(float(x), 6) for x in lr.interceptVector.toArray()), weights, 0.0)
        best = predict(F.col("t"), model)
        held = sorted(((r.p, r.ok) for r in rows.where("held").select(best["p"].alias("p"), best["family"].alias("f"), (best["family"] == F.col("family")).alias("ok")).collect()
                       if r.f not in (UNKNOWN, NONE)), reverse=True)
    finally:
        rows.unpersist()
    right, threshold = 0, 1.0
    for n, (p, ok) in enumerate(held, 1):
        right += ok
        tied = n < len(held) and held[n][0] == p
        if not tied and right >= least_precision * n:
            threshold = p
    return Model(classes, model.bias, weights, threshold)


def predict(paragraph: Column, model: Model) -> Column:
    """struct(p, family): the likeliest class and its probability."""
    table = F.create_map(*[x for g, w in model.weights.items() for x in (F.lit(g), F.array(*[F.lit(v) for v in w]))])
    bias = F.array(*[F.lit(b) for b in model.bias])
    logits = F.aggregate(features(paragraph), bias, lambda s, g: F.coalesce(F.zip_with(s, table[g], lambda a, b: a + b), s))
    names = F.array(*[F.lit(c) for c in model.classes])

    def softmax(z: Column) -> Column:
        top = F.array_max(z)
        total = F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top))
        return F.struct((1 / total).alias("p"), F.element_at(names, F.array_position(z, top).cast("int")).alias("family"))

    return let(logits, softmax)


def _confirmed(paragraph: Column, family: Column) -> Column:
    """Whether a template of the family is contained in the paragraph."""
    def inside(own: Column) -> Column:
        shares = [(k, F.array(*[F.lit(x) for x in sorted(_pairs_of(t))])) for k, v in TEMPLATES.items() for t in v]
        out = F.lit(False)
        for k, t in shares:
            out = out | (family == k) & (F.size(F.array_intersect(t, own)) >= CONTAINED * F.size(t))
        return out

    return let(pairs(paragraph), inside)


def _pairs_of(text: str) -> set[str]:
    import re

    t = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())
    return {" ".join(x) for x in zip(t, t[1:])}


def notices(text: Column, model: Model) -> Column:
    """Array of struct(paragraph, family, p) for the paragraphs of a text that are notices."""
    def classify(line: Column, i: Column) -> Column:
        return let(predict(line, model), lambda b: F.struct(
            i.cast("long").alias("paragraph"),
            F.when(b["family"].isin(UNKNOWN, NONE), b["family"]).when((b["p"] >= model.threshold) & _confirmed(line, b["family"]), b["family"]).otherwise(UNKNOWN).alias("family"),
            b["p"].alias("p")))

    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    cued = F.filter(lines, lambda s: s["x"].rlike(CUES))
    found = F.filter(F.transform(cued, lambda s: classify(s["x"], s["i"])), lambda x: x["family"] != NONE)
    none = F.array().cast("array<struct<paragraph:bigint,family:string,p:double>>")
    return F.when(text.rlike(CUES), found).otherwise(none)


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with notices, and licences: the distinct families of the notices in order of name."""
    own = ("notices", "licences")
    out = docs.select(*[F.col(c) for c in docs.columns if c.lower() not in own], notices(F.coalesce(F.col(text), F.lit("")), model).alias("notices"))
    return out.withColumn("licences", F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))))
