"""From marts to the columns each model is fitted on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.errors import UntrainableData
from tillcast.operators.calendar import with_month_index
from tillcast.operators.encoding import (
    INDICATORS,
    Categories,
    category_sets,
    indicator_columns,
    with_indicators,
)
from tillcast.operators.marts import CUSTOMER_TRAITS, DRIVERS

CALENDAR = ("Year", "Month", "Quarter", "IsHolidaySL")
LINEAR_FEATURES = (*CALENDAR, "MonthIndex", *DRIVERS)
FOREST_FEATURES = (*CALENDAR, *DRIVERS)

CUSTOMER_NUMBERS = ("Year", "Month", "TotalSpent", "TotalQuantity", "PurchaseCount")
# The purchase count is left on its own scale.
CUSTOMER_SCALED = ("TotalSpent", "TotalQuantity", "Year", "Month")
# In the order of the fitted columns.
CUSTOMER_CATEGORIES = ("Gender", "CountryRegionName", "EmailPromotion")


@dataclass(frozen=True)
class MartFacts:
    """What a mart must tell before its features can be built."""

    categories: Categories
    first_year: int | None
    last_year: int | None


@dataclass(frozen=True)
class Encoded:
    """A frame, the columns a model takes from it, and the names of its features: the
    indicators are one vector column of many features."""

    frame: DataFrame
    columns: list[str]
    features: list[str]

    def as_columns(self) -> DataFrame:
        """The frame with a column of its own for each feature."""
        if INDICATORS not in self.frame.columns:
            return self.frame
        own = set(self.frame.columns)
        return indicator_columns(self.frame, [n for n in self.features if n not in own])


def mart_facts(mart: DataFrame, columns: Sequence[str]) -> MartFacts:
    """Categories and year bounds by one pass over the mart."""
    bounds = (F.min("Year").alias("MinYear"), F.max("Year").alias("MaxYear"))
    row = mart.agg(*bounds, *category_sets(columns)).first()
    categories = Categories({c: list(row[c]) for c in columns})
    return MartFacts(categories, row["MinYear"], row["MaxYear"])


def customer_columns(mart: DataFrame, categories: Categories) -> Encoded:
    """Numbers and trait indicators by the categories given."""
    frame, names = with_indicators(mart, categories, CUSTOMER_CATEGORIES)
    return Encoded(
        frame, [*CUSTOMER_NUMBERS, *[INDICATORS] * bool(names)], [*CUSTOMER_NUMBERS, *names]
    )


def regional_columns(mart: DataFrame, categories: Categories, base_year: int) -> Encoded:
    """Territory indicators, month index and the drivers."""
    dated = with_month_index(mart, base_year)
    frame, names = with_indicators(dated, categories, ["TerritoryName"])
    numbers = ["MonthIndex", *DRIVERS]
    return Encoded(frame, [*[INDICATORS] * bool(names), *numbers], [*names, *numbers])


def customer_features(mart: DataFrame) -> Encoded:
    """Numbers and trait indicators; the categories are the mart's own.

    A model scores with the categories it was fitted on: see :func:`customer_columns`.
    """
    return customer_columns(mart, mart_facts(mart, CUSTOMER_TRAITS).categories)


def regional_features(mart: DataFrame) -> Encoded:
    """Territory indicators, month index from the mart's first year, and the drivers."""
    facts = mart_facts(mart, ["TerritoryName"])
    if facts.first_year is None:
        raise UntrainableData("the history is empty")
    return regional_columns(mart, facts.categories, facts.first_year)
