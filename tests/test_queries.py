"""Every registered query against its SQL on the smallest test tables."""

import re

import pytest
from check_queries import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SF

ALL = sorted(n for n in oracle_sql() if not re.match(r"op\d|pipeline", n))  # those have tests of their own


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ALL)
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert compare(rows, res.fetchall(), df.columns, columns) == ""


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 1000
    assert {r["verdict"] for r in rows} <= {"ALLOW", "FLAG", "BLOCK"}


def test_registry():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 100
