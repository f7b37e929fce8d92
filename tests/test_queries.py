"""Every registered query against its SQL counterpart, and the shape of its plan."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
import check

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return check.duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    result = [tuple(r) for r in df.collect()]
    assert result, "a query must not be empty"
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        theirs = ([d[0] for d in cursor.description], cursor.fetchall())
        assert check.compare((df.columns, result), theirs) == ""


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
