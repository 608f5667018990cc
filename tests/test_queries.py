"""Every registered query against its SQL on the smallest test tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, problems = compare(spark, con, QUERIES[name], ORACLE.get(name), SF_DIR)
    assert not problems


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["word", "variant", "n_units", "cost", "rank"]
    assert df.count() > 0
