"""Territory names and the territory-by-month spine."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillcast.operators.calendar import expand_months


def territory_names(mart: DataFrame) -> DataFrame:
    """Distinct territory names in the regional mart."""
    return mart.select("TerritoryName").distinct()


def territory_month_spine(
    mart: DataFrame, year: int, months: list[int], territory: str | None = None
) -> DataFrame:
    """One row per territory and month.

    A territory given by name needs no history: it is taken as it is, and a name the
    model has not seen gets the base-level indicators.
    """
    if territory:
        # A row and not a literal: a constant key would take the join to the model's
        # categories its equality.
        names = mart.sparkSession.createDataFrame([(territory,)], "TerritoryName string")
    else:
        names = territory_names(mart)
    return expand_months(names, year, months)
