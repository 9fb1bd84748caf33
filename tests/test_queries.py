"""Every registered query against its SQL, over the smallest test tables."""

import pytest

import __spark_entry__ as registered
from compare import compare
from pactlens.queries import ORACLES, QUERIES


# Row-wise Python and all-pairs joins have no place in any plan.
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, duck, folder, name):
    df = registered.queries()[name](spark, folder)
    difference, _ = compare(duck, name, df)
    assert difference is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [text for text in FORBIDDEN if text in plan]


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(registered.queries()) and set(ORACLES) <= set(registered.oracle_sql())


def test_entry(spark):
    assert registered.entry(spark).count() > 0
