"""Standardisation with the population standard deviation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALER_SCHEMA = "column string, mean double, std double"


@dataclass(frozen=True)
class Scaler:
    """Mean and divisor of each column; one entry per feature, so it is always tiny."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaler:
        row = scaler_stats(df, columns).first()
        return cls({c: (row[f"{c}_mean"], row[f"{c}_std"]) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: (F.col(c).cast("double") - F.lit(mean)) / F.lit(std)
                for c, (mean, std) in self.stats.items()
            }
        )

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, mean, std) for c, (mean, std) in self.stats.items()]
        return spark.createDataFrame(rows, SCALER_SCHEMA).coalesce(1)

    @classmethod
    def from_df(cls, df: DataFrame) -> Scaler:
        return cls({r["column"]: (r["mean"], r["std"]) for r in df.collect()})


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``<column>_mean`` and ``<column>_std``; a constant column divides by 1."""
    stats = []
    for c in columns:
        value = F.col(c).cast("double")
        spread = F.stddev_pop(value)
        stats.append(F.avg(value).alias(f"{c}_mean"))
        stats.append(F.when(spread == 0, 1.0).otherwise(spread).alias(f"{c}_std"))
    return df.agg(*stats)
