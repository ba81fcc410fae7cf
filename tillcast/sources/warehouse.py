"""The marts computed where the star lives: one GROUP BY sent over JDBC.

A monthly mart has a few hundred rows at any fact size. Sent as the reader's ``query``, its
aggregate runs in the warehouse and months, not lines, cross the wire. The customer mart
grows with the customers and is read in parallel by ranges of its key.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.operators.marts import CUSTOMER_TRAITS, DRIVERS
from tillcast.sources.star import CUSTOMERS, DATES, FACT, SCHEMAS, TERRITORIES, jdbc_options


@dataclass(frozen=True)
class Dialect:
    """What a database writes in its own way."""

    # Days from one yyyymmdd key to another, with {a} and {b} for the keys.
    days: str
    # A quotient of integers cut toward zero, with {a} and {b}.
    quotient: str
    floating: str
    long: str
    count: str


def _dated(parse: str, day: str) -> str:
    return day.format(a=parse.format(key="{a}"), b=parse.format(key="{b}"))


DIALECTS = {
    "tsql": Dialect(
        days=_dated(
            "CONVERT(date, CONVERT(char(8), {key}), 112)", "DATEDIFF(day, {a}, {b})"
        ),
        quotient="{a} / {b}",
        floating="float",
        long="bigint",
        count="COUNT_BIG",
    ),
    "duckdb": Dialect(
        days=_dated(
            "CAST(strptime(CAST({key} AS VARCHAR), '%Y%m%d') AS DATE)", "date_diff('day', {a}, {b})"
        ),
        quotient="{a} // {b}",
        floating="DOUBLE",
        long="BIGINT",
        count="COUNT",
    ),
    "spark": Dialect(
        days=_dated("to_date(CAST({key} AS STRING), 'yyyyMMdd')", "datediff({b}, {a})"),
        quotient="{a} div {b}",
        floating="DOUBLE",
        long="BIGINT",
        count="COUNT",
    ),
}


@dataclass(frozen=True)
class MartQuery:
    """Keys as grouped and as shown, the totals, whether the drivers follow, and the joins."""

    keys: tuple[tuple[str, str], ...]
    totals: tuple[tuple[str, str, T.DataType], ...]
    drivers: bool
    tables: tuple[str, ...]


_CALENDAR = (("Year", "{d}.Year"), ("Month", "{d}.Month"))
_DAY_KEYS = (*_CALENDAR, ("Quarter", "{d}.Quarter"), ("IsHolidaySL", "{d}.IsHolidaySL"))
_UNITS = "SUM(CAST({f}.OrderQty AS {long}))"
MARTS = {
    "monthly_sales": MartQuery(
        _DAY_KEYS, (("TotalSales", "SUM({f}.LineTotal)", T.DoubleType()),), True, (DATES,)
    ),
    "monthly_demand": MartQuery(_DAY_KEYS, (("TotalQty", _UNITS, T.LongType()),), True, (DATES,)),
    "regional_monthly": MartQuery(
        (("TerritoryName", "{t}.TerritoryName"), *_CALENDAR),
        (("TotalSales", _UNITS, T.LongType()),),
        True,
        (DATES, TERRITORIES),
    ),
    "customer_monthly": MartQuery(
        (
            ("CustomerKey", "{f}.CustomerKey"),
            *_CALENDAR,
            *((c, f"{{c}}.{c}") for c in CUSTOMER_TRAITS),
        ),
        (
            ("TotalSpent", "SUM({f}.TotalDue)", T.DoubleType()),
            ("TotalQuantity", _UNITS, T.LongType()),
            ("PurchaseCount", "{count}({f}.SalesOrderID)", T.LongType()),
        ),
        False,
        (DATES, CUSTOMERS),
    ),
}

_TYPES = {
    **{f.name: f.dataType for schema in SCHEMAS.values() for f in schema},
    "TotalOrders": T.LongType(),
    "UniqueCustomers": T.LongType(),
    "AvgUnitPrice": T.DoubleType(),
    "AvgDiscount": T.DoubleType(),
    "AvgShippingTime": T.LongType(),
}
_ON = {DATES: ("d", "OrderDateKey", "DateKey"), TERRITORIES: ("t", "TerritoryKey", "TerritoryKey"),
       CUSTOMERS: ("c", "CustomerKey", "CustomerKey")}


def mart_columns(mart: str) -> list[str]:
    """Columns of a mart in their order."""
    told = MARTS[mart]
    keys, totals = [k for k, _ in told.keys], [t[0] for t in told.totals]
    if mart == "customer_monthly":
        return [*keys[:3], *totals, *keys[3:]]
    if mart == "regional_monthly":
        return [*keys, "TotalSales", *DRIVERS]
    return [*keys, *totals, *DRIVERS]


def mart_sql(
    mart: str,
    dialect: str,
    table_names: Mapping[str, str] | None = None,
    year: int | None = None,
    month: int | None = None,
) -> str:
    """The SELECT that computes a mart in the warehouse, optionally for a year or month.

    Groups are those of the raw calendar columns; the NULL default is shown after the
    grouping, so NULL and 0 stay apart and print the same key. Averages of days are cut
    toward zero.
    """
    own, told = DIALECTS[dialect], MARTS[mart]
    names = {**{t: t for t in SCHEMAS}, **(table_names or {})}
    alias = {"f": "f", "d": "d", "t": "t", "c": "c", "long": own.long, "count": own.count}
    days = own.days.format(a="f.OrderDateKey", b="f.ShipDateKey")
    columns = {name: sql.format(**alias) for name, sql, _ in told.totals}
    if told.drivers:
        total_days, shipped = f"SUM(CAST({days} AS {own.long}))", f"NULLIF({own.count}({days}), 0)"
        columns |= {
            "TotalOrders": f"{own.count}(DISTINCT f.SalesOrderID)",
            "AvgUnitPrice": f"AVG(CAST(f.UnitPrice AS {own.floating}))",
            "AvgDiscount": f"AVG(CAST(f.UnitPriceDiscount AS {own.floating}))",
            "UniqueCustomers": f"{own.count}(DISTINCT f.CustomerKey)",
            "AvgShippingTime": own.quotient.format(a=total_days, b=shipped),
        }
    keys = {name: sql.format(**alias) for name, sql in told.keys}
    for name in ("Quarter", "IsHolidaySL"):
        if name in keys:
            columns[name] = f"COALESCE({keys[name]}, 0)"
    shown = ", ".join(f"{columns.get(c) or keys[c]} AS {c}" for c in mart_columns(mart))
    joins = "".join(
        f" JOIN {names[table]} {_ON[table][0]} ON f.{_ON[table][1]} = {_ON[table][0]}.{_ON[table][2]}"
        for table in told.tables
    )
    chosen = [f"d.{c} = {int(v)}" for c, v in (("Year", year), ("Month", month)) if v]
    where = f" WHERE {' AND '.join(chosen)}" if chosen else ""
    return f"SELECT {shown} FROM {names[FACT]} f{joins}{where} GROUP BY {', '.join(keys.values())}"


def conform_mart(df: DataFrame, mart: str) -> DataFrame:
    """A mart's columns in its types, whatever the database returned them as."""
    kinds = {**_TYPES, **{name: kind for name, _, kind in MARTS[mart].totals}}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in mart_columns(mart)])


def jdbc_mart(
    spark: SparkSession,
    options: Mapping[str, str],
    mart: str,
    dialect: str = "tsql",
    table_names: Mapping[str, str] | None = None,
    year: int | None = None,
    month: int | None = None,
    split: Mapping[str, object] | None = None,
) -> DataFrame:
    """A mart aggregated by the warehouse and read over JDBC.

    ``options`` holds url, driver and credentials. The customer mart needs a ``split`` on
    one of its columns, such as CustomerKey: see :func:`counted_split`.
    """
    sql = mart_sql(mart, dialect, table_names, year, month)
    if mart == "customer_monthly" and split is None:
        raise ValueError("customer_monthly grows with the customers and needs a split")
    if split is None:
        chosen = {**options, "query": sql}
    else:
        # The reader splits a table, not a query.
        chosen = jdbc_options(f"({sql}) mart", options, split)
    return conform_mart(spark.read.format("jdbc").options(**chosen).load(), mart)


def counted_split(
    spark: SparkSession,
    options: Mapping[str, str],
    table: str,
    column: str,
    rows_per_task: int = 1_000_000,
) -> dict[str, object]:
    """The four partitioning options for a table, from its smallest and largest key and its
    number of rows, which the warehouse counts."""
    sql = f"SELECT MIN({column}) AS low, MAX({column}) AS high, COUNT(*) AS held FROM {table}"
    row = spark.read.format("jdbc").options(**{**options, "query": sql}).load().first()
    low, high, held = (row[name] for name in ("low", "high", "held"))
    if not held or low is None:
        low = high = 0
    tasks = min(max(1, -(-int(held) // rows_per_task)), int(high) - int(low) + 1)
    # The upper bound is exclusive.
    return {
        "partitionColumn": column,
        "lowerBound": int(low),
        "upperBound": int(high) + 1,
        "numPartitions": tasks,
    }
