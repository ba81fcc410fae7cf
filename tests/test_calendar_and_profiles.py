import pytest
from pyspark.errors import PySparkException

from tests.conftest import rows
from tillcast.operators.calendar import chosen_months, month_spine, with_month_index, year_bounds
from tillcast.operators.marts import DRIVERS
from tillcast.operators.profiles import (
    attach_profile,
    future_from_means,
    future_from_profile,
    global_means,
    month_profile,
)
from tillcast.operators.territories import territory_month_spine, territory_names

SCHEMA = (
    "TerritoryName string, Year int, Month int, Quarter int, IsHolidaySL int, TotalOrders long, "
    "AvgUnitPrice double, AvgDiscount double, UniqueCustomers long, AvgShippingTime long"
)


@pytest.fixture
def mart(spark):
    return spark.createDataFrame(
        [
            ("North", 2019, 1, 1, 0, 10, 1.0, 0.1, 4, 2),
            ("North", 2019, 1, 1, 1, 1, 3.0, 0.3, 1, 3),
            ("South", 2021, 1, 1, 0, 4, 5.0, 0.2, 1, -4),
            ("North", 2020, 7, 3, 0, 8, 7.0, 0.0, 2, 0),
        ],
        SCHEMA,
    )


def test_all_months_or_one():
    assert chosen_months(None) == list(range(1, 13))
    assert chosen_months(12) == [12]


@pytest.mark.parametrize("month", [0, 13, -1, 1.5, "3", True])
def test_impossible_months(month):
    with pytest.raises(ValueError, match="month"):
        chosen_months(month)


def test_spine(spark):
    got = rows(month_spine(spark, 2030, [3, 4]))
    assert got == [(2030, 3, 1), (2030, 4, 2)]


def test_year_bounds(mart):
    assert rows(year_bounds(mart)) == [(2019, 2021)]


def test_month_index_from_first_or_given_year(mart):
    assert rows(with_month_index(mart), "MonthIndex") == [(1,), (1,), (19,), (25,)]
    assert rows(with_month_index(mart, 2018), "MonthIndex") == [(13,), (13,), (31,), (37,)]


def test_profile_is_unweighted_over_mart_rows(mart):
    got = {r["Month"]: r for r in month_profile(mart).collect()}
    assert got[1]["TotalOrders"] == pytest.approx(5.0)
    assert got[1]["AvgUnitPrice"] == pytest.approx(3.0)
    assert got[1]["AvgShippingTime"] == pytest.approx(1 / 3)
    assert got[7]["UniqueCustomers"] == 2.0


def test_global_means(mart):
    got = global_means(mart).first()
    assert got["IsHolidaySL"] == 0.25
    assert got["TotalOrders"] == 5.75


def test_future_rows_have_no_holiday_and_follow_the_base_year(spark, mart):
    future = future_from_profile(month_spine(spark, 2022, [1, 7]), mart, 2019, [1, 7])
    got = rows(future, "Year", "Month", "Quarter", "IsHolidaySL", "MonthIndex", "AvgUnitPrice")
    assert got == [(2022, 1, 1, 0, 37, 3.0), (2022, 7, 3, 0, 43, 7.0)]


def test_month_without_history_fails_or_gives_null(spark, mart):
    spine = month_spine(spark, 2022, [1, 2])
    with pytest.raises(PySparkException, match="no history for month 2"):
        attach_profile(spine, mart, [1, 2]).collect()
    allowed = attach_profile(spine, mart, [1, 2], allow_missing=True)
    assert rows(allowed, "Month", "TotalOrders") == [(1, 5.0), (2, None)]


def test_every_future_month_gets_the_same_means(mart):
    got = future_from_means(mart, 2025, [1, 12]).collect()
    assert [(r["Year"], r["Month"], r["Quarter"]) for r in got] == [(2025, 1, 1), (2025, 12, 4)]
    assert [[r[c] for c in DRIVERS] for r in got][0] == [got[1][c] for c in DRIVERS]


def test_territory_spine(mart):
    assert rows(territory_names(mart)) == [("North",), ("South",)]
    every = territory_month_spine(mart, 2022, [1, 2]).select("TerritoryName", "Month")
    assert rows(every) == [("North", 1), ("North", 2), ("South", 1), ("South", 2)]
    unknown = territory_month_spine(mart, 2022, [5], "Atlantis")
    assert rows(unknown, "TerritoryName", "Year", "Month") == [("Atlantis", 2022, 5)]
