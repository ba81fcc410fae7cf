"""Null defaults, flags and the integer mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def positive_flag(value: Column) -> Column:
    """1 when the value is above zero, else 0; NULL counts as 0."""
    return F.when(value > 0, 1).otherwise(0)


def truncated_mean(value: Column) -> Column:
    """Aggregate: mean of an integer column cut toward zero, NULLs ignored.

    This is what an average over integers returns in the warehouse's dialect:
    -3 and -4 average to -3.
    """
    return F.call_function("div", F.sum(value), F.nullif(F.count(value), F.lit(0)))


def two_decimals(value: Column) -> Column:
    """Text with two decimals, for reports."""
    return F.format_string("%.2f", value)
