"""Every registered query against its SQL, and the shape of its plan."""

import pytest

from quotelock.plans import catalog
from tests.oracle import compare, connect

QUERIES = catalog.load()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, folder, duck, name):
    result = QUERIES[name].build(spark, folder)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    passed, note = compare(spark, duck, folder, QUERIES[name], result)
    assert passed, note


def test_every_query_has_sql():
    assert [name for name, query in QUERIES.items() if query.sql is None] == []
