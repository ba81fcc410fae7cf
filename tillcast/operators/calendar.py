"""Month index, year bounds and the months to predict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions import month_index, quarter_of_month


def year_bounds(mart: DataFrame) -> DataFrame:
    """One row: first and last year of the history."""
    return mart.agg(F.min("Year").alias("MinYear"), F.max("Year").alias("MaxYear"))


def with_month_index(mart: DataFrame, base_year: int | None = None) -> DataFrame:
    """Add ``MonthIndex``, counted from ``base_year`` or else from the mart's first year.

    Without a base year the mart is evaluated twice; pass a stored mart.
    """
    base: Column
    if base_year is None:
        base = mart.agg(F.min("Year")).scalar()
    else:
        base = F.lit(base_year)
    return mart.withColumn("MonthIndex", month_index(F.col("Year"), F.col("Month"), base))


def chosen_months(month: int | None) -> list[int]:
    """All twelve months, or the one asked for."""
    if month is None:
        return list(range(1, 13))
    if isinstance(month, bool) or not isinstance(month, int) or not 1 <= month <= 12:
        raise ValueError(f"month must be 1 to 12 or None, got {month!r}")
    return [month]


def expand_months(df: DataFrame, year: int, months: list[int]) -> DataFrame:
    """Repeat every row once per month and set the calendar columns."""
    month = F.explode(F.array(*[F.lit(m) for m in months])).alias("Month")
    return df.select("*", F.lit(year).alias("Year"), month).withColumn(
        "Quarter", quarter_of_month(F.col("Month"))
    )


def month_spine(spark: SparkSession, year: int, months: list[int]) -> DataFrame:
    """Year, Month, Quarter for the months to predict."""
    return expand_months(spark.range(1).select(), year, months)
