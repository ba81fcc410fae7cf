"""A hold-out split that is the same on every run and every cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_bucket(keys: Sequence[str], seed: int = 42) -> Column:
    """0 to 99 from the row's key; independent of partitioning and row order."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100


def in_training_part(keys: Sequence[str], percent: int = 80, seed: int = 42) -> Column:
    return hash_bucket(keys, seed) < percent


def holdout_split(
    df: DataFrame, keys: Sequence[str], percent: int = 80, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by key hash; sizes are close to the share asked for."""
    train = in_training_part(keys, percent, seed)
    return df.filter(train), df.filter(~train)
