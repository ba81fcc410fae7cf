"""The sales star schema and its readers."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.operators.joins import fits_broadcast, hint_if

FACT = "FactSalesOrderDetail"
DATES = "DimDate"
TERRITORIES = "DimTerritory"
CUSTOMERS = "DimCustomer"

MONEY = T.DecimalType(19, 4)

SCHEMAS = {
    FACT: T.StructType(
        [
            T.StructField("SalesOrderID", T.LongType(), False),
            T.StructField("OrderDateKey", T.IntegerType(), False),
            T.StructField("ShipDateKey", T.IntegerType(), True),
            T.StructField("CustomerKey", T.LongType(), False),
            T.StructField("TerritoryKey", T.IntegerType(), False),
            T.StructField("OrderQty", T.IntegerType(), False),
            T.StructField("UnitPrice", T.DoubleType(), False),
            T.StructField("UnitPriceDiscount", T.DoubleType(), False),
            T.StructField("LineTotal", MONEY, False),
            T.StructField("TotalDue", MONEY, False),
        ]
    ),
    DATES: T.StructType(
        [
            T.StructField("DateKey", T.IntegerType(), False),
            T.StructField("Year", T.IntegerType(), False),
            T.StructField("Month", T.IntegerType(), False),
            T.StructField("Quarter", T.IntegerType(), True),
            T.StructField("IsHolidaySL", T.IntegerType(), True),
        ]
    ),
    TERRITORIES: T.StructType(
        [
            T.StructField("TerritoryKey", T.IntegerType(), False),
            T.StructField("TerritoryName", T.StringType(), False),
        ]
    ),
    CUSTOMERS: T.StructType(
        [
            T.StructField("CustomerKey", T.LongType(), False),
            T.StructField("Gender", T.StringType(), True),
            T.StructField("EmailPromotion", T.IntegerType(), True),
            T.StructField("CountryRegionName", T.StringType(), True),
        ]
    ),
}


@dataclass(frozen=True)
class StarSchema:
    """Four tables; ``fact`` may be of any size, the dimensions are checked before a broadcast.

    ``rescan_is_cheap`` says that reading a few columns of ``fact`` again costs little,
    as it does for a columnar table and not for a view over joins or a remote table.
    """

    fact: DataFrame
    dates: DataFrame
    territories: DataFrame
    customers: DataFrame
    rescan_is_cheap: bool = False

    @cached_property
    def _dates_fit(self) -> bool:
        return fits_broadcast(self.dates)

    @cached_property
    def _territories_fit(self) -> bool:
        return fits_broadcast(self.territories)

    def dated_lines(self, year: int | None = None, month: int | None = None) -> DataFrame:
        """Fact lines with their calendar columns, optionally for one year or month.

        The filter is on the calendar, whose year need not be the key's year. For a
        year the lowest and highest matching date key also bound the fact scan, so
        files and row groups outside them are skipped.
        """
        days = self.dates
        if year:
            days = days.filter(F.col("Year") == year)
        if month:
            days = days.filter(F.col("Month") == month)
        fact = self.fact
        if year:
            fact = fact.filter(
                F.col("OrderDateKey").between(
                    days.agg(F.min("DateKey")).scalar(), days.agg(F.max("DateKey")).scalar()
                )
            )
        days = hint_if(self._dates_fit, days)
        return fact.join(days, fact["OrderDateKey"] == days["DateKey"])

    def territory_lines(self) -> DataFrame:
        """Dated fact lines with the territory's name."""
        names = hint_if(self._territories_fit, self.territories)
        return self.dated_lines().join(names, "TerritoryKey")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select a table's columns in its fixed types; a value that does not fit raises."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table]])


def parquet_star(spark: SparkSession, root: str) -> StarSchema:
    """Read ``<root>/<table>`` parquet folders named as the tables are."""
    return StarSchema(
        *[
            conform(spark.read.parquet(f"{root}/{table}"), table)
            for table in (FACT, DATES, TERRITORIES, CUSTOMERS)
        ],
        rescan_is_cheap=True,
    )


def jdbc_options(
    table: str,
    options: Mapping[str, str],
    split: Mapping[str, object] | None = None,
) -> dict[str, str]:
    """Reader options for one table; ``split`` needs all four partitioning options."""
    needed = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
    if split is not None and set(split) != needed:
        raise ValueError(f"split needs exactly {sorted(needed)}")
    return {
        **options,
        **{name: str(value) for name, value in (split or {}).items()},
        "dbtable": table,
    }


#: Tables that grow with the business; one task must not read them alone.
SPLIT_TABLES = (FACT, CUSTOMERS)


def jdbc_star(
    spark: SparkSession,
    options: Mapping[str, str],
    splits: Mapping[str, Mapping[str, object]],
    table_names: Mapping[str, str] | None = None,
) -> StarSchema:
    """Read the star over JDBC.

    ``options`` holds url, driver and credentials from the caller's secret store. ``splits``
    has for each table the options (partitionColumn, lowerBound, upperBound, numPartitions)
    that make its scan parallel; the fact and the customers need theirs, which
    :func:`counted_split` gets from the warehouse.
    """
    missing = [t for t in SPLIT_TABLES if t not in splits]
    if missing:
        raise ValueError(f"a split is needed for {', '.join(missing)}")
    unknown = set(splits) - set(SCHEMAS)
    if unknown:
        raise ValueError(f"no such table: {', '.join(sorted(unknown))}")
    names = {**{t: t for t in SCHEMAS}, **(table_names or {})}

    def read(table: str) -> DataFrame:
        chosen = jdbc_options(names[table], options, splits.get(table))
        return conform(spark.read.format("jdbc").options(**chosen).load(), table)

    return StarSchema(read(FACT), read(DATES), read(TERRITORIES), read(CUSTOMERS))
