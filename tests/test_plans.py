"""What the physical plans must show."""

import re

import pytest
from pyspark.sql import functions as F

import tillcast as tc
from tests.conftest import line, rows
from tillcast.operators.customers import latest_month
from tillcast.operators.encoding import category_sets
from tillcast.operators.marts import customer_months, with_traits
from tillcast.sources.star import CUSTOMERS, DATES, FACT, TERRITORIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from tillcast import retail_star

    root = str(tmp_path_factory.mktemp("star"))
    star = retail_star(spark, "/root/testdata/sf0.001")
    for name, table in [
        (FACT, star.fact),
        (DATES, star.dates),
        (TERRITORIES, star.territories),
        (CUSTOMERS, star.customers),
    ]:
        table.write.parquet(f"{root}/{name}")
    return tc.parquet_star(spark, root)


def fact_columns(plan: str) -> list[set[str]]:
    scans = re.findall(rf"FileScan parquet \[([^\]]*)\][^\n]*{FACT}", plan)
    return [{c.split("#")[0] for c in scan.split(",")} for scan in scans]


def test_each_scan_of_the_fact_reads_only_what_it_needs(stored):
    scans = fact_columns(plan_of(tc.monthly_sales(stored)))
    key = "OrderDateKey"
    assert sorted(map(sorted, scans)) == sorted(
        map(
            sorted,
            [
                {key, "ShipDateKey", "UnitPrice", "UnitPriceDiscount", "LineTotal"},
                {key, "SalesOrderID"},
                {key, "CustomerKey"},
            ],
        )
    )


def test_customer_mart_reduces_the_fact_before_the_join(stored):
    plan = plan_of(tc.customer_monthly(stored))
    assert fact_columns(plan) == [
        {"SalesOrderID", "OrderDateKey", "CustomerKey", "OrderQty", "TotalDue"}
    ]
    # One shuffle for the whole mart, fed by the partial sums.
    assert len(re.findall(r"[^t]Exchange hashpartitioning", plan)) == 1
    assert plan.index("sum(spent") < plan.index("Exchange hashpartitioning")


def test_year_filter_reaches_the_fact_scan(stored):
    plan = plan_of(tc.customer_monthly(stored, 2000))
    fact_scan = next(s for s in plan.splitlines() if "FileScan" in s and FACT in s)
    assert "subquery" in fact_scan.lower()
    assert "EqualTo(Year,2000)" in plan


def test_last_month_is_limited_before_the_shuffle(stored):
    plan = plan_of(latest_month(tc.customer_monthly(stored)))
    limits = [m.start() for m in re.finditer("WindowGroupLimit", plan)]
    assert len(limits) == 2
    assert limits[0] < plan.index("Exchange hashpartitioning(CustomerKey") < limits[1]


def test_scoring_meets_the_customers_with_one_row_each(stored):
    """The last month is picked before the join, from the partial results of each task."""
    latest = latest_month(with_traits(stored, latest_month(customer_months(stored, 2000))))
    plan = plan_of(latest)
    # The formatted tree reads from the result down: the join lies above the inner window.
    inner = [m.start() for m in re.finditer("WindowGroupLimit", plan)]
    assert plan.index("Join [CustomerKey") < inner[-1]
    assert "TotalDue" in plan[inner[-1] :]


def test_helpers_pass_over_the_mart_once(stored, spark, tmp_path):
    """Categories and year bounds come from one job; the encoding itself runs none."""
    tc.write_mart(tc.regional_monthly(stored), f"{tmp_path}/mart")
    mart = spark.read.parquet(f"{tmp_path}/mart")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("helpers", "helpers")
    try:
        encoded = tc.regional_features(mart)
        jobs = tracker.getJobIdsForGroup("helpers")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # One scan stage and one stage that merges its tasks' results.
    assert len(jobs) <= 2
    facts = plan_of(mart.agg(F.min("Year"), *category_sets(["TerritoryName"])))
    assert facts.count("FileScan") == 1
    assert plan_of(encoded.frame).count("FileScan") == 1


def test_view_over_joins_is_scanned_once(retail):
    plan = plan_of(tc.monthly_sales(retail))
    assert plan.count("lineitem.parquet") == 1
    assert "Expand" in plan


def test_hot_keys_are_split_up_before_the_count(make_star):
    """A month's orders are counted by all tasks: the shuffle key includes the order."""
    plan = plan_of(tc.monthly_sales(make_star([line()], rescan_is_cheap=True)))
    assert re.search(r"hashpartitioning\(Year#[^)]*, SalesOrderID#", plan)
    assert re.search(r"hashpartitioning\(Year#[^)]*, CustomerKey#", plan)


def test_hot_order_and_hot_customer_are_split(spark, tmp_path):
    """A third of the lines in one order, a third of the orders with one customer.

    The size from which Spark splits a join partition is lowered to the test's scale.
    """
    source = "/root/testdata/sf0.001"
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name) for name in settings}
    hot = F.col("o_orderkey") % 3 == 0
    lines = spark.read.parquet(f"{source}/lineitem.parquet").repartition(8)
    orders = spark.read.parquet(f"{source}/orders.parquet").repartition(8)
    lines.withColumn(
        "l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_orderkey"))
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.withColumn("o_custkey", F.when(hot, 1).otherwise(F.col("o_custkey"))).write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    for name in ("customer", "nation", "region"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    expected = rows(tc.monthly_demand(tc.retail_star(spark, str(tmp_path))))
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        mart = tc.monthly_demand(tc.retail_star(spark, str(tmp_path)))
        got = rows(mart)
        final = plan_of(mart)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert "SortMergeJoin(skew=true)" in final
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        assert g == pytest.approx(e, rel=1e-12)
