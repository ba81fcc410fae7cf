"""Categories to 0/1 indicators, with the first sorted category as the base level.

A NULL, the base level and a category unseen at fit time all get zeros throughout.
The fitted categories are stored with the model, so scoring a subset of the data
cannot move the base level. Whatever the number of categories, a column's indicators
are slots of a sparse vector, found by one lookup.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators.joins import BROADCAST_BYTES, hint_if

INDICATORS = "Indicators"
VOCABULARY_SCHEMA = "column string, position int, value string"


@dataclass(frozen=True)
class Categories:
    """Sorted categories of each column, as text. Each but the first becomes a feature, so
    they are as small as the model."""

    values: dict[str, list[str]]

    @classmethod
    def from_df(cls, vocabulary: DataFrame) -> Categories:
        held: dict[str, list[str]] = {}
        for row in sorted(vocabulary.collect(), key=lambda r: (r["column"], r["position"])):
            held.setdefault(row["column"], []).append(row["value"])
        return cls(held)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, i, v) for c, own in self.values.items() for i, v in enumerate(own)]
        return spark.createDataFrame(rows, VOCABULARY_SCHEMA).coalesce(1)


def category_sets(columns: Sequence[str]) -> list[Column]:
    """Aggregates: each column's distinct non-NULL values as sorted text.

    Integers sort as numbers, text by code point. Each task keeps only its distinct values
    before the shuffle.
    """
    return [
        F.transform(F.sort_array(F.collect_set(c)), lambda v: v.cast("string")).alias(c)
        for c in columns
    ]


def category_vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The categories of all columns as rows: column, position in sorted order, value."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns]
    one = df.agg(*category_sets(columns)).select(F.inline(F.array(*entries)))
    return one.select("column", F.posexplode("values").alias("position", "value"))


def indicator_names(column: str, values: Sequence[str], taken: set[str] | None = None) -> list[str]:
    """A name for every category but the base level; ``taken`` holds names used before.

    Dots and quotes become underscores; the position keeps clashing names apart.
    """
    taken = set() if taken is None else taken
    names = []
    for position, value in enumerate(values):
        if position == 0:
            continue
        name = f"{column}_{value}".replace(".", "_").replace("`", "_")
        # Column names differ by more than case.
        while name.lower() in taken:
            name = f"{name}_{position}"
        taken.add(name.lower())
        names.append(name)
    return names


def indicator_blocks(categories: Categories, columns: Sequence[str]) -> list[int]:
    """The slots of each column that has any, in their order in ``Indicators``."""
    sizes = [len(categories.values.get(c, [])) - 1 for c in columns]
    return [n for n in sizes if n > 0]


def with_indicators(
    df: DataFrame, categories: Categories, columns: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """Add one sparse vector ``Indicators`` for all ``columns``; returns the names of its slots.

    A column's categories are joined to their slots: by broadcast while they are small, else
    as Spark sees fit. The last slot, which the encoder drops, takes the base level and the
    unknown. A column of fewer than two categories has no slot.
    """
    spark = df.sparkSession
    names: list[str] = []
    taken: set[str] = set()
    slots: list[str] = []
    for c in columns:
        values = categories.values.get(c, [])
        if len(values) < 2:
            continue
        names += indicator_names(c, values, taken)
        none = len(values) - 1
        lookup = spark.createDataFrame(
            [(v, float(slot)) for slot, v in enumerate(values[1:])],
            f"`lookup_{c}` string, `slot_{c}` double",
        )
        small = sum(len(v.encode()) + 32 for v in values) <= BROADCAST_BYTES
        key = F.col(c).cast("string") == F.col(f"lookup_{c}")
        df = df.join(hint_if(small, lookup), key, "left").drop(f"lookup_{c}")
        # The number of slots is told, so that the encoder needs no pass to find it.
        told = {"ml_attr": {"type": "nominal", "num_vals": none + 1}}
        slot = F.coalesce(F.col(f"slot_{c}"), F.lit(float(none))).alias(f"slot_{c}", metadata=told)
        df = df.select(*[F.col(other) for other in df.columns if other != f"slot_{c}"], slot)
        slots.append(f"slot_{c}")
    if not slots:
        return df, names
    vectors = [f"vector_{s}" for s in slots]
    encoder = OneHotEncoder(inputCols=slots, outputCols=vectors, dropLast=True)
    joined = VectorAssembler(inputCols=vectors, outputCol=INDICATORS)
    return joined.transform(encoder.fit(df).transform(df)).drop(*slots, *vectors), names


def indicator_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with one 0/1 column for each slot of ``Indicators``."""
    if not names:
        return df
    slots = df.withColumn(INDICATORS, vector_to_array(INDICATORS))
    return slots.select(
        *[c for c in df.columns if c != INDICATORS],
        *[F.col(INDICATORS)[i].alias(name) for i, name in enumerate(names)],
    )


def align_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``keep`` and the fitted columns in order: missing ones are 0, others go."""
    return df.select(
        *keep, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns]
    )
