import random
from collections import defaultdict
from decimal import Decimal

import pytest

import tillcast as tc
from tests.conftest import JANUARY, line, rows
from tillcast.operators import joins


def test_null_and_zero_holiday_stay_apart(make_star):
    star = make_star(
        [line(1, 20200106), line(2, 20200107), line(3, 20200107)],
        dates=[(20200106, 2020, 1, 1, None), (20200107, 2020, 1, 1, 0)],
    )
    got = rows(tc.monthly_sales(star), "Year", "Month", "IsHolidaySL", "TotalOrders")
    assert got == [(2020, 1, 0, 1), (2020, 1, 0, 2)]


def test_null_quarter_prints_zero(make_star):
    star = make_star([line()], dates=[(20200106, 2020, 1, None, 1)])
    assert rows(tc.monthly_demand(star), "Quarter", "IsHolidaySL") == [(0, 1)]


def test_average_shipping_is_cut_toward_zero(make_star):
    star = make_star([line(1, ship=20200103), line(2, ship=20200102)])
    assert rows(tc.monthly_sales(star), "AvgShippingTime") == [(-3,)]


def test_unshipped_lines_do_not_count_in_the_average(make_star):
    star = make_star([line(1, ship=None), line(2, ship=20200111)])
    assert rows(tc.monthly_sales(star), "AvgShippingTime") == [(5,)]
    unshipped = make_star([line(1, ship=None)])
    assert rows(tc.monthly_sales(unshipped), "AvgShippingTime") == [(None,)]


def test_orders_are_distinct_and_purchases_are_lines(make_star):
    star = make_star([line(7), line(7)])
    assert rows(tc.monthly_sales(star), "TotalOrders", "UniqueCustomers") == [(1, 1)]
    assert rows(tc.customer_monthly(star), "PurchaseCount") == [(2,)]


def test_sales_are_money_or_units(make_star):
    star = make_star([line(quantity=3, total="10.5000"), line(quantity=4, total="0.2500")])
    assert rows(tc.monthly_sales(star), "TotalSales") == [(10.75,)]
    assert rows(tc.monthly_demand(star), "TotalQty") == [(7,)]
    assert rows(tc.regional_monthly(star), "TotalSales") == [(7,)]


def test_territories_with_one_name_merge(make_star):
    star = make_star(
        [line(1, territory=1), line(2, territory=2)], territories=[(1, "North"), (2, "North")]
    )
    got = rows(tc.regional_monthly(star), "TerritoryName", "TotalOrders")
    assert got == [("North", 2)]


def test_lines_without_a_dimension_row_are_left_out(make_star):
    star = make_star([line(1), line(2, day=20210101), line(3, customer=9), line(4, territory=9)])
    assert rows(tc.monthly_sales(star), "TotalOrders") == [(3,)]
    assert sum(r[0] for r in rows(tc.regional_monthly(star), "TotalOrders")) == 2
    assert rows(tc.customer_monthly(star), "CustomerKey", "PurchaseCount") == [(1, 2)]


def test_customer_listed_twice_counts_per_listing(make_star):
    same = make_star([line(due="2.0000")], customers=[(1, "F", 0, "France")] * 2)
    assert rows(tc.customer_monthly(same), "TotalSpent", "PurchaseCount") == [(4.0, 2)]
    moved = make_star([line()], customers=[(1, "F", 0, "France"), (1, "F", 0, "Spain")])
    got = rows(tc.customer_monthly(moved), "CountryRegionName", "PurchaseCount")
    assert got == [("France", 1), ("Spain", 1)]


def test_customer_year_and_month(make_star):
    dates = [JANUARY, (20200301, 2020, 3, 1, 0), (20210301, 2021, 3, 1, 0)]
    star = make_star([line(i, day=d[0]) for i, d in enumerate(dates)], dates=dates)
    assert rows(tc.customer_monthly(star, 2020), "Year", "Month") == [(2020, 1), (2020, 3)]
    assert rows(tc.customer_monthly(star, month=3), "Year", "Month") == [(2020, 3), (2021, 3)]
    assert rows(tc.customer_monthly(star, 2021, 1), "Year", "Month") == []


def test_fiscal_year_differs_from_the_key(make_star):
    """The year filter follows the calendar table, not the digits of the key."""
    dates = [(20200701, 2021, 1, 1, 0), (20210701, 2022, 1, 1, 0)]
    star = make_star([line(1, day=20200701), line(2, day=20210701)], dates=dates)
    assert rows(tc.customer_monthly(star, 2021), "Year", "PurchaseCount") == [(2021, 1)]


def test_money_does_not_overflow(make_star):
    big = "900000000000000.0000"
    star = make_star([line(i, total=big) for i in range(3)])
    assert rows(tc.monthly_sales(star), "TotalSales") == [(2.7e15,)]


@pytest.mark.parametrize("rescan_is_cheap", [False, True])
def test_marts_against_brute_force(make_star, rescan_is_cheap):
    """Random lines with one customer, order and day holding a third of them each."""
    rng = random.Random(5)
    dates = [
        (20200100 + d, 2020, 1, rng.choice([1, None, 0]), rng.choice([0, 1, None]))
        for d in range(1, 29)
    ]
    lines = [
        line(
            order=1 if rng.random() < 0.33 else rng.randrange(40),
            day=20200101 if rng.random() < 0.33 else 20200100 + rng.randrange(1, 29),
            ship=rng.choice([None, 20200100 + rng.randrange(1, 29)]),
            customer=1 if rng.random() < 0.33 else rng.randrange(20),
            territory=rng.randrange(1, 4),
            quantity=rng.randrange(1, 9),
            price=rng.randrange(1, 999) / 4,
            discount=rng.randrange(0, 8) / 8,
            total=f"{rng.randrange(10**7)}.{rng.randrange(10**4):04d}",
        )
        for _ in range(600)
    ]
    star = make_star(
        lines,
        dates,
        territories=[(1, "North"), (2, "South"), (3, "North")],
        rescan_is_cheap=rescan_is_cheap,
    )
    calendar = {d[0]: d[1:] for d in dates}
    names = {1: "North", 2: "South", 3: "North"}

    def expected(group, total):
        groups = defaultdict(list)
        for entry in lines:
            groups[group(entry)].append(entry)
        for found in groups.values():
            days = [(e[2] - e[1]) for e in found if e[2] is not None]
            yield (
                total(found),
                len({e[0] for e in found}),
                sum(e[6] for e in found) / len(found),
                sum(e[7] for e in found) / len(found),
                len({e[3] for e in found}),
                int(sum(days) / len(days)) if days else None,
            )

    def close(got, wanted):
        wanted = sorted(wanted, key=repr)
        assert len(got) == len(wanted)
        for g, w in zip(got, wanted, strict=True):
            assert g == pytest.approx(w, rel=1e-12)

    drivers = ("TotalOrders", "AvgUnitPrice", "AvgDiscount", "UniqueCustomers", "AvgShippingTime")
    close(
        rows(tc.monthly_sales(star), "TotalSales", *drivers),
        expected(lambda e: calendar[e[1]], lambda f: float(sum(Decimal(e[8]) for e in f))),
    )
    close(
        rows(tc.monthly_demand(star), "TotalQty", *drivers),
        expected(lambda e: calendar[e[1]], lambda f: sum(e[5] for e in f)),
    )
    close(
        rows(tc.regional_monthly(star), "TotalSales", *drivers),
        expected(lambda e: names[e[4]], lambda f: sum(e[5] for e in f)),
    )


def test_dimensions_beyond_the_bound_are_not_broadcast(make_star, monkeypatch):
    """No hint is given then, and the result is the same."""
    lines = [line(1), line(2, day=20200203)]

    def plan(star):
        return star.territory_lines()._jdf.queryExecution().analyzed().toString()

    small = make_star(lines)
    assert plan(small).count("ResolvedHint") == 2
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 10)
    large = make_star(lines)
    assert "ResolvedHint" not in plan(large)
    assert rows(tc.regional_monthly(large)) == rows(tc.regional_monthly(small))
