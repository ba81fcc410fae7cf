"""Spark settings the jobs are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime re-planning: small partitions are merged, skewed join partitions are
    # split, and a join side that turns out small is broadcast.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    # A bad date key or an overflow must fail the job, not become NULL.
    "spark.sql.ansi.enabled": "true",
}


def configure(builder: SparkSession.Builder, shuffle_partitions: int) -> SparkSession.Builder:
    """Apply the settings; ``shuffle_partitions`` is the count before AQE merges them.

    A few times the executor cores is a good start on a cluster (for example 20000
    on 1000 executors), the core count in local mode.
    """
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
