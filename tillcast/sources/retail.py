"""The star schema as views over order-processing tables.

Maps ``lineitem``, ``orders``, ``customer``, ``nation`` and ``region`` parquet files
to the four star tables, for the acceptance queries and the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions import key_from_date
from tillcast.sources.star import StarSchema
from tillcast.staging import stage

# Month * 100 + day of the days flagged as holidays.
HOLIDAYS = (101, 204, 413, 414, 501, 1225)


def retail_star(spark: SparkSession, folder: str) -> StarSchema:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    nation, customer = table("nation"), table("customer")
    orders, lineitem = table("orders"), table("lineitem")

    buyers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    # Orders meet customers before the line items do: the largest table is shuffled
    # once, on the order key, instead of once per join.
    sold = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey"),
        F.col("o_custkey").alias("CustomerKey"),
        F.col("n_regionkey").alias("TerritoryKey"),
        key_from_date(F.col("o_orderdate")).alias("OrderDateKey"),
    )
    discount = F.col("l_discount").cast("decimal(4,2)")
    line_total = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - discount)
    fact = lineitem.join(sold, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("SalesOrderID"),
        F.col("OrderDateKey"),
        key_from_date(F.col("l_shipdate")).alias("ShipDateKey"),
        F.col("CustomerKey"),
        F.col("TerritoryKey"),
        F.col("l_quantity").cast("int").alias("OrderQty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("UnitPrice"),
        F.col("l_discount").alias("UnitPriceDiscount"),
        line_total.alias("LineTotal"),
        (line_total * (1 + F.col("l_tax").cast("decimal(4,2)"))).alias("TotalDue"),
    )

    day = F.col("o_orderdate")
    dates = orders.select(
        key_from_date(day).alias("DateKey"),
        F.year(day).alias("Year"),
        F.month(day).alias("Month"),
        F.quarter(day).alias("Quarter"),
        F.when(F.dayofmonth(day) == 31, F.lit(None).cast("int"))
        .when((F.month(day) * 100 + F.dayofmonth(day)).isin(*HOLIDAYS), 1)
        .otherwise(0)
        .alias("IsHolidaySL"),
    ).distinct()
    # A few thousand days out of all orders: derived once, then read as a small table.
    dates = stage(dates, "dim_date")

    territories = table("region").select(
        F.col("r_regionkey").alias("TerritoryKey"), F.col("r_name").alias("TerritoryName")
    )
    customers = buyers.select(
        F.col("c_custkey").alias("CustomerKey"),
        F.col("c_mktsegment").alias("Gender"),
        (F.col("c_custkey") % 3).cast("int").alias("EmailPromotion"),
        F.col("n_name").alias("CountryRegionName"),
    )
    return StarSchema(fact, dates, territories, customers)
