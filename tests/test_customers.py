import pytest

from tests.conftest import rows
from tillcast.operators.customers import latest_month, next_purchase_label

SCHEMA = (
    "CustomerKey long, Year int, Month int, TotalSpent double, TotalQuantity long, "
    "PurchaseCount long, Gender string, EmailPromotion int, CountryRegionName string"
)


@pytest.fixture
def mart(spark):
    def build(*keys):
        data = [(c, y, m, 1.0, 1, 1, "F", 0, "France") for c, y, m in keys]
        return spark.createDataFrame(data, SCHEMA)

    return build


def test_next_observed_month_counts_across_gaps(mart):
    got = next_purchase_label(mart((1, 2020, 1), (1, 2020, 4), (2, 2020, 2)))
    assert rows(got, "CustomerKey", "Month", "NextPurchase") == [(1, 1, 1), (1, 4, 0), (2, 2, 0)]


def test_order_is_by_year_then_month(mart):
    got = next_purchase_label(mart((1, 2019, 12), (1, 2020, 1)))
    assert rows(got, "Year", "NextPurchase") == [(2019, 1), (2020, 0)]


def test_latest_month_after_a_filter(mart):
    history = mart((1, 2000, 5), (1, 2000, 3), (1, 2001, 2), (2, 2001, 1))
    assert rows(latest_month(history), "CustomerKey", "Year", "Month") == [(1, 2001, 2), (2, 2001, 1)]
    in_2000 = latest_month(history.filter("Year = 2000"))
    assert rows(in_2000, "CustomerKey", "Year", "Month") == [(1, 2000, 5)]


def test_tie_between_listings_is_settled_the_same_way(spark):
    data = [(1, 2020, 1, 1.0, 1, 1, g, 0, "France") for g in ("F", "M")]
    one = latest_month(spark.createDataFrame(data, SCHEMA))
    other = latest_month(spark.createDataFrame(data[::-1], SCHEMA))
    assert rows(one) == rows(other)
    assert one.count() == 1
