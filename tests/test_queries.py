"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import checks
from checks.compare import compare, connection

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()

# stated for one scale only: known figures, planted counts above the small table's means
SCALE_BOUND = {"l03_known_figures"}


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", [n for n in checks.load_all()[0] if n not in SCALE_BOUND])
def test_query(spark, con, name):
    ok, text = compare(spark, con, SF_DIR, QUERIES[name], SQL.get(name))
    assert ok, text


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
