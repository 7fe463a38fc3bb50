"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(SQL))
def test_same_rows(spark, con, key):
    result = compare.compare(spark, con, QUERIES[key], SQL[key], SF_DIR)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, key):
    assert QUERIES[key](spark, SF_DIR).count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"grp", "cell_id", "n_uncharacterized"} <= set(df.columns)
