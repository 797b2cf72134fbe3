"""Held-out accuracy of the classifier, and what it must not call a licence."""

import pytest

from fleetscope.llm import licences as L
from fleetscope.llm.queries import table

from .cases import frame

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.train(table(spark, FOLDER, "documents").select("doc_id", "text"))


def found(spark, model, *texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, notices string")
    return [r["licences"] for r in sorted(L.scan(df, model).collect(), key=lambda r: r["doc_id"])]


def test_templates_within_text(spark, model):
    told = [(k, t) for k, v in L.TEMPLATES.items() for t in v]
    texts = [f"some words before\n{t}\nand after" for _, t in told] + [f"Ond there {t.lower()} inte" for _, t in told]
    assert found(spark, model, *texts) == [[k] for k, _ in told] * 2


def test_unknown_and_none(spark, model):
    assert found(spark, model, "Licensed under the Zanzibar License, Version 2.0.") == [["unknown"]]
    got = found(spark, model, None, "", "plain words\nmore words", "he had a license and the rights of man " * 2)
    assert got[:3] == [[], [], []]


def test_lines_of_the_shared_documents(spark, model):
    """Every planted notice gets its family, no other document gets one."""
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
             "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary"}
    rows = L.scan(table(spark, FOLDER, "documents"), model).collect()
    for r in rows:
        assert r["licences"] == sorted({k for line in r["text"].split("\n") for t, k in lines.items() if t in line}), r["doc_id"]


def test_held_out(spark, model):
    rows = L.examples(table(spark, FOLDER, "documents")).where("held")
    best = L.predict(rows["t"], model)
    got = rows.select("family", best["family"].alias("f"), best["p"].alias("p")).collect()
    sure = [r for r in got if r["f"] not in (L.UNKNOWN, L.NONE) and r["p"] >= model.threshold]
    assert sum(r["f"] == r["family"] for r in sure) >= 0.99 * len(sure)
    assert sum(r["f"] == r["family"] for r in got) >= 0.95 * len(got)


def test_empty_long_and_repeated(spark, model):
    assert L.scan(frame(spark, []), model).count() == 0
    assert L.train(frame(spark, [])).classes[-1] == L.NONE
    long = "word " * 50_000 + "\nAll rights reserved."
    assert found(spark, model, long, long) == [["proprietary"]] * 2


def test_native(spark, model):
    text = L.scan(frame(spark), model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text
