from __future__ import annotations

import tempfile
from collections.abc import Sequence

import pytest
from pyspark.sql import SparkSession

from tillcast.session import configure
from tillcast.sources.star import (
    CUSTOMERS,
    DATES,
    FACT,
    SCHEMAS,
    TERRITORIES,
    StarSchema,
    conform,
)


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        configure(SparkSession.builder.master("local[8]").appName("tests"), 8)
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
    return session


# Date key, year, month, quarter, holiday flag.
JANUARY = (20200106, 2020, 1, 1, 0)
FEBRUARY = (20200203, 2020, 2, 1, 0)
APRIL = (20200406, 2020, 4, 2, 0)


def line(
    order: int = 1,
    day: int = 20200106,
    ship: int | None = 20200108,
    customer: int = 1,
    territory: int = 1,
    quantity: int = 1,
    price: float = 10.0,
    discount: float = 0.0,
    total: str = "10.0000",
    due: str = "11.0000",
) -> tuple:
    return (order, day, ship, customer, territory, quantity, price, discount, total, due)


@pytest.fixture
def make_star(spark):
    """A star from literal rows; money is given as text."""

    def build(
        lines: Sequence[tuple],
        dates: Sequence[tuple] = (JANUARY, FEBRUARY, APRIL),
        territories: Sequence[tuple] = ((1, "North"), (2, "South")),
        customers: Sequence[tuple] = ((1, "F", 0, "France"), (2, "M", 1, "Spain")),
        rescan_is_cheap: bool = False,
    ) -> StarSchema:
        fact = spark.createDataFrame(
            list(lines),
            "SalesOrderID long, OrderDateKey int, ShipDateKey int, CustomerKey long, "
            "TerritoryKey int, OrderQty int, UnitPrice double, UnitPriceDiscount double, "
            "LineTotal string, TotalDue string",
        )
        return StarSchema(
            conform(fact, FACT),
            spark.createDataFrame(list(dates), SCHEMAS[DATES]),
            spark.createDataFrame(list(territories), SCHEMAS[TERRITORIES]),
            spark.createDataFrame(list(customers), SCHEMAS[CUSTOMERS]),
            rescan_is_cheap,
        )

    return build


@pytest.fixture(scope="session")
def retail(spark) -> StarSchema:
    from tillcast import retail_star

    return retail_star(spark, "/root/testdata/sf0.001")


def rows(df, *columns: str) -> list[tuple]:
    """Rows of the chosen columns (or all) in sorted order."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
