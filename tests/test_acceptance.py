"""Every registered query at the smallest scale, against its SQL where there is one."""

import pytest

import __spark_entry__ as driver
from acceptance.compare import differences
from acceptance.oracle import ORACLES
from acceptance.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
FORESTS = {
    "forecast_sales_forest",
    "forecast_regional",
    "forecast_regional_one_territory",
    "score_customers",
    "score_customers_in_year",
    "top_customers",
}
# Operators that write Python workers, all pairs, or whole tables into one task.
UNWANTED = ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval", "MapInPandas")


def test_only_forests_lack_sql():
    assert set(QUERIES) - set(ORACLES) == FORESTS
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    result = QUERIES[name](spark, FOLDER)
    assert differences(result, FOLDER, name) is None
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in UNWANTED if word in plan]


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert driver.queries().keys() >= QUERIES.keys()
    assert driver.oracle_sql().keys() >= ORACLES.keys()
