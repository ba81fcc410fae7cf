"""The four aggregate marts.

All joins are inner. Averages are per line and unweighted, distinct counts exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions import shipping_days, truncated_mean, zero_if_null
from tillcast.operators.distincts import grouped_with_distincts

if TYPE_CHECKING:
    from tillcast.sources.star import StarSchema

# What a month's sales are explained by, besides the calendar.
DRIVERS = ("TotalOrders", "AvgUnitPrice", "AvgDiscount", "UniqueCustomers", "AvgShippingTime")
CUSTOMER_TRAITS = ("Gender", "EmailPromotion", "CountryRegionName")


def _with_drivers(star: StarSchema, lines: DataFrame, keys: Sequence[str], total: Column) -> DataFrame:
    """Group ``lines`` and compute ``total`` and the drivers."""
    days = shipping_days(F.col("OrderDateKey"), F.col("ShipDateKey"))
    plain = [
        total,
        F.avg("UnitPrice").alias("AvgUnitPrice"),
        F.avg("UnitPriceDiscount").alias("AvgDiscount"),
        truncated_mean(days).alias("AvgShippingTime"),
    ]
    distinct = {"TotalOrders": "SalesOrderID", "UniqueCustomers": "CustomerKey"}
    return grouped_with_distincts(lines, keys, plain, distinct, star.rescan_is_cheap)


def _monthly(star: StarSchema, total: Column, name: str) -> DataFrame:
    # Grouped on the raw calendar columns: NULL and 0 stay apart and then print the
    # same key, so the NULL default comes after the aggregate.
    keys = ("Year", "Month", "Quarter", "IsHolidaySL")
    return _with_drivers(star, star.dated_lines(), keys, total.alias(name)).select(
        "Year",
        "Month",
        zero_if_null(F.col("Quarter")).alias("Quarter"),
        zero_if_null(F.col("IsHolidaySL")).alias("IsHolidaySL"),
        name,
        *DRIVERS,
    )


def monthly_sales(star: StarSchema) -> DataFrame:
    """Money by year, month, quarter and holiday flag."""
    # Summed as decimals, so the result does not depend on the order of the rows.
    return _monthly(star, F.sum("LineTotal").cast("double"), "TotalSales")


def monthly_demand(star: StarSchema) -> DataFrame:
    """Units by year, month, quarter and holiday flag."""
    return _monthly(star, F.sum("OrderQty"), "TotalQty")


def regional_monthly(star: StarSchema) -> DataFrame:
    """Units by territory name and month. ``TotalSales`` counts units here, not money."""
    keys = ("TerritoryName", "Year", "Month")
    units = F.sum("OrderQty").alias("TotalSales")
    return _with_drivers(star, star.territory_lines(), keys, units).select(
        *keys, "TotalSales", *DRIVERS
    )


def customer_monthly(
    star: StarSchema, year: int | None = None, month: int | None = None
) -> DataFrame:
    """Spending, units and lines by customer and month, with the customer's traits.

    The fact is reduced to customer-months before it meets DimCustomer, so a customer
    with a third of all lines arrives at the join as a few rows. A customer listed
    more than once counts once per listing; the second sum adds those up and needs no
    further shuffle, because the join output is already distributed by the key.
    """
    return with_traits(star, customer_months(star, year, month))


def customer_months(
    star: StarSchema, year: int | None = None, month: int | None = None
) -> DataFrame:
    """Spending, units and lines by customer and month, from the fact alone."""
    return (
        star.dated_lines(year, month)
        .groupBy("CustomerKey", "Year", "Month")
        .agg(
            F.sum("TotalDue").alias("spent"),
            F.sum("OrderQty").alias("units"),
            F.count("SalesOrderID").alias("lines"),
        )
    )


def with_traits(star: StarSchema, months: DataFrame) -> DataFrame:
    """Customer-months with the customer's traits, in the form of the mart."""
    traits = star.customers.select("CustomerKey", *CUSTOMER_TRAITS)
    return (
        months.join(traits, "CustomerKey")
        .groupBy("CustomerKey", "Year", "Month", *CUSTOMER_TRAITS)
        .agg(
            F.sum("spent").cast("double").alias("TotalSpent"),
            F.sum("units").alias("TotalQuantity"),
            F.sum("lines").alias("PurchaseCount"),
        )
        .select(
            "CustomerKey",
            "Year",
            "Month",
            "TotalSpent",
            "TotalQuantity",
            "PurchaseCount",
            *CUSTOMER_TRAITS,
        )
    )
