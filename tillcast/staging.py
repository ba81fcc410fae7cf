"""Tables written once and read many times.

Model training passes over its input repeatedly, so the input is written to the
shared checkpoint folder first: the star join runs once, later passes read only
the columns they need, and a lost executor costs a re-read instead of the join.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a local folder only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.gettempdir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/tillcast/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    For results that outlive the call; the folder's owner clears it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """Like :func:`stage`, but the table is dropped when the block ends."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _drop(spark, path)


@contextmanager
def scratch_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """A shared folder for tables, dropped when the block ends."""
    path = scratch_path(spark, label)
    try:
        yield path
    finally:
        _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
