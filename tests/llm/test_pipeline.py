"""The pipeline against plain versions of its stages, and the queries against their SQL."""

import math

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fleetscope.llm import decontaminate, mixing
from fleetscope.llm.queries import EXPECTED, QUERIES, table, tokenizer_path
from tools.check import TABLES, compare

from . import test_decontaminate, test_quality, test_simhash
from .cases import crc

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def staged(spark, upto):
    """Output of each of the first stages, as run() makes it."""
    docs, out = table(spark, FOLDER, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), "test")
        out.append(docs)
    return out


def test_stages_and_run(spark):
    outs = staged(spark, 4)
    assert all(o.columns == COLUMNS for o in outs)
    docs = {r["doc_id"]: r["text"] for r in table(spark, FOLDER, "documents").collect()}
    good = {d for d, t in docs.items() if test_quality.verdict(test_quality.plain(t))[1]}
    assert {r["doc_id"] for r in outs[0].collect()} == good
    one = {d for d, m in test_simhash.classes({d: test_simhash.plain(docs[d]) for d in good}).items() if d == m}
    assert {r["doc_id"] for r in outs[1].collect()} == one and one < good
    items = [decontaminate.plain(r["text"]) for r in table(spark, FOLDER, "benchmark").collect()]
    clean = {d for d in one if not any(test_decontaminate.distance(p, decontaminate.plain(docs[d])) <= math.floor(0.2 * len(p)) for p in items)}
    assert {r["doc_id"] for r in outs[2].collect()} == clean and clean < one
    placed = sorted(mixing.positions(outs[2]).collect(), key=lambda r: (r["slot"], r["place"]))
    order = [r["doc_id"] for r in placed]
    assert sorted(set(order)) == sorted(clean)
    t, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for d in order:
        ids = t.encode(docs[d], add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), crc(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r)[:4] for r in corpus_pipeline.run(spark, FOLDER).collect()), key=lambda r: r[1])
    assert got == want


def test_token_stage_without_files(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "doc_id long, text string")
    got = sorted(corpus_pipeline.tokens(spark, df, FOLDER).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [1, 2]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    said, _ = compare(spark, con, name, QUERIES[name], EXPECTED.get(name), FOLDER)
    assert said.startswith(("ok", "rows-only"))
    source = "pages" if name.startswith(("op4_", "op9_")) else "documents"
    n = int(said.split()[1])
    rows = con.execute(f"SELECT count(*) FROM {source}").fetchone()[0]
    assert n == rows if not name.startswith(("op2_", "op7_")) else n > 0
