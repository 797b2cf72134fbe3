"""Every catalogue query against its expected-result SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from fleetscope.catalog import load
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
QUERIES, EXPECTED = load().QUERIES, load().EXPECTED


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_query_has_expected_sql():
    assert set(QUERIES) == set(EXPECTED)
    assert set(QUERIES) <= set(entry.queries()) and set(EXPECTED) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    verdict, _ = compare(spark, con, name, QUERIES[name], EXPECTED[name], FOLDER)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "top5_event" in df.columns
