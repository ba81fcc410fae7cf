"""Typical values carried into future months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.operators.calendar import expand_months, with_month_index
from tillcast.operators.marts import DRIVERS


def month_profile(mart: DataFrame) -> DataFrame:
    """Mean of each driver by calendar month: unweighted over the mart's rows."""
    return mart.groupBy("Month").agg(*[F.avg(c).alias(c) for c in DRIVERS])


def global_means(mart: DataFrame) -> DataFrame:
    """One row: mean of the holiday flag and of each driver over the whole mart."""
    return mart.agg(*[F.avg(c).alias(c) for c in ("IsHolidaySL", *DRIVERS)])


def attach_profile(
    spine: DataFrame, mart: DataFrame, months: list[int], allow_missing: bool = False
) -> DataFrame:
    """Give every spine row its month's profile.

    A month without history fails the query, or yields NULL with ``allow_missing``.
    Only the chosen months are profiled, so the broadcast side has at most twelve rows
    and the filter reaches the calendar below the mart.
    """
    profile = month_profile(mart.filter(F.col("Month").isin(months))).withColumn(
        "known", F.lit(True)
    )
    joined = spine.join(F.broadcast(profile), "Month", "left")
    if not allow_missing:
        missing = F.concat(F.lit("no history for month "), F.col("Month").cast("string"))
        checked = [
            F.when(F.col("known"), F.col(c)).otherwise(F.raise_error(missing).cast("double"))
            for c in DRIVERS
        ]
        joined = joined.withColumns(dict(zip(DRIVERS, checked, strict=True)))
    return joined.drop("known")


def future_from_profile(
    spine: DataFrame,
    mart: DataFrame,
    base_year: int,
    months: list[int],
    allow_missing: bool = False,
) -> DataFrame:
    """Feature rows of the monthly models: calendar, no holiday, the month's profile."""
    dated = with_month_index(spine, base_year).withColumn("IsHolidaySL", F.lit(0))
    return attach_profile(dated, mart, months, allow_missing)


def future_from_means(mart: DataFrame, year: int, months: list[int]) -> DataFrame:
    """Feature rows of the sales forest: calendar plus the same global means every month.

    The one-row aggregate is expanded by month, so nothing is joined.
    """
    return expand_months(global_means(mart), year, months)
