"""Where results go: records for a service, tables for the next job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row in a column ``value``; NULL fields are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_results(df: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """Write a scorer's rows in any format Spark writes."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.save(path)


def write_mart(mart: DataFrame, path: str, mode: str = "error") -> None:
    """Save a mart by year, so that a job on one year reads one folder.

    The rebalance hint gathers a year's rows into few files and splits a year that
    is too large for one task.
    """
    balanced = mart.hint("rebalance", F.col("Year"))
    balanced.write.mode(mode).partitionBy("Year").parquet(path)
