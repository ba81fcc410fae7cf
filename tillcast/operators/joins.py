"""Broadcast only what was measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame) -> bool:
    """Measure a dimension's rows and text: 16 bytes per column plus string bytes."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    size = F.count("*") * (16 * len(df.columns))
    for name in text:
        size = size + F.coalesce(F.sum(F.octet_length(name)), F.lit(0))
    return df.agg(size.alias("bytes")).first()["bytes"] <= BROADCAST_BYTES


def hint_if(fits: bool, df: DataFrame) -> DataFrame:
    """Hint the broadcast, or leave the strategy to Spark (with its skew-join splitting)."""
    return F.broadcast(df) if fits else df
