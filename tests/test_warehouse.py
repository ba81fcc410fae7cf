"""Marts aggregated by the warehouse: the generated SQL against the marts, and the reader's options."""

from decimal import Decimal

import duckdb
import pytest

import tillcast as tc
from tests.conftest import line, rows
from tillcast.sources.star import CUSTOMERS, DATES, FACT, TERRITORIES
from tillcast.sources.warehouse import MARTS, conform_mart, mart_columns, mart_sql

BUILD = {
    "monthly_sales": tc.monthly_sales,
    "monthly_demand": tc.monthly_demand,
    "regional_monthly": tc.regional_monthly,
    "customer_monthly": tc.customer_monthly,
}


def star_tables(star):
    return {FACT: star.fact, DATES: star.dates, TERRITORIES: star.territories, CUSTOMERS: star.customers}


def small_star(make_star):
    """Null and 0 holiday flags in one month, missing and early shipments, a repeated order."""
    dates = [(20200106, 2020, 1, 1, 0), (20200131, 2020, 1, 1, None), (20200203, 2020, 2, None, 1)]
    lines = [
        line(1, ship=20200102),
        line(1, ship=20200103, quantity=2, customer=2),
        line(2, day=20200131, ship=None, territory=2),
        line(3, day=20200203, ship=20200229, discount=0.25, total="3.3333"),
        line(4, day=20200203, ship=None, territory=2, customer=2),
    ]
    return make_star(lines, dates)


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for x, y in zip(g, w, strict=True):
            assert x == (pytest.approx(y, rel=1e-12) if isinstance(y, float) else y)


@pytest.mark.parametrize("mart", MARTS)
@pytest.mark.parametrize("which", ["small", "retail"])
def test_generated_sql_gives_the_mart(spark, make_star, retail, tmp_path, mart, which):
    star = small_star(make_star) if which == "small" else retail
    database = duckdb.connect()
    for name, table in star_tables(star).items():
        table.write.parquet(f"{tmp_path}/{name}")
        database.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
        table.createOrReplaceTempView(name)
    expected = BUILD[mart](star)
    found = database.execute(mart_sql(mart, "duckdb"))
    assert [c[0] for c in found.description] == expected.columns == mart_columns(mart)
    plain = [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in found.fetchall()]
    near(sorted(plain, key=repr), rows(expected))
    in_spark = conform_mart(spark.sql(mart_sql(mart, "spark")), mart)
    assert in_spark.dtypes == expected.dtypes
    near(rows(in_spark), rows(expected))


def test_year_and_month_are_filtered_in_the_warehouse(make_star, spark):
    star = small_star(make_star)
    for name, table in star_tables(star).items():
        table.createOrReplaceTempView(name)
    sql = mart_sql("customer_monthly", "spark", year=2020, month=2)
    assert "WHERE d.Year = 2020 AND d.Month = 2" in sql
    assert rows(conform_mart(spark.sql(sql), "customer_monthly")) == rows(tc.customer_monthly(star, 2020, 2))


def test_the_warehouse_dialect():
    sql = mart_sql("monthly_sales", "tsql", {FACT: "dbo.FactSales"})
    assert sql.startswith("SELECT d.Year AS Year, d.Month AS Month, COALESCE(d.Quarter, 0) AS Quarter")
    assert "FROM dbo.FactSales f JOIN DimDate d ON f.OrderDateKey = d.DateKey" in sql
    assert sql.endswith("GROUP BY d.Year, d.Month, d.Quarter, d.IsHolidaySL")
    assert "DATEDIFF(day, CONVERT(date, CONVERT(char(8), f.OrderDateKey), 112)" in sql
    assert "COUNT_BIG(DISTINCT f.SalesOrderID) AS TotalOrders" in sql


class Warehouse:
    """A stand-in for a session whose reader runs the query in Spark."""

    def __init__(self, spark):
        self.spark, self.seen = spark, []
        self.read = self

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, **options):
        self.seen.append(options)
        return self

    def load(self):
        chosen = self.seen[-1]
        return self.spark.sql(chosen.get("query") or f"SELECT * FROM {chosen['dbtable']}")


def test_a_monthly_mart_is_one_query(make_star, spark):
    star = small_star(make_star)
    for name, table in star_tables(star).items():
        table.createOrReplaceTempView(name)
    warehouse = Warehouse(spark)
    mart = tc.jdbc_mart(warehouse, {"url": "jdbc:example:"}, "monthly_sales", dialect="spark")
    near(rows(mart), rows(tc.monthly_sales(star)))
    assert list(warehouse.seen[0]) == ["url", "query"]


def test_the_customer_mart_is_read_by_ranges(make_star, spark):
    star = small_star(make_star)
    for name, table in star_tables(star).items():
        table.createOrReplaceTempView(name)
    warehouse = Warehouse(spark)
    with pytest.raises(ValueError, match="split"):
        tc.jdbc_mart(warehouse, {}, "customer_monthly", dialect="spark")
    split = tc.counted_split(warehouse, {"url": "x"}, CUSTOMERS, "CustomerKey", rows_per_task=1)
    assert split == {
        "partitionColumn": "CustomerKey", "lowerBound": 1, "upperBound": 3, "numPartitions": 2,
    }
    mart = tc.jdbc_mart(warehouse, {"url": "x"}, "customer_monthly", dialect="spark", split=split)
    near(rows(mart), rows(tc.customer_monthly(star)))
    assert warehouse.seen[-1]["numPartitions"] == "2" and "query" not in warehouse.seen[-1]


def test_split_of_an_empty_table_and_of_few_keys(make_star, spark):
    warehouse = Warehouse(spark)
    spark.range(0).withColumnRenamed("id", "k").createOrReplaceTempView("nothing")
    split = tc.counted_split(warehouse, {}, "nothing", "k")
    assert (split["lowerBound"], split["upperBound"], split["numPartitions"]) == (0, 1, 1)
    spark.range(100).selectExpr("id % 2 AS k").createOrReplaceTempView("two")
    split = tc.counted_split(warehouse, {}, "two", "k", rows_per_task=10)
    assert (split["upperBound"], split["numPartitions"]) == (2, 2)
