"""Mixing sources to target weights by Poisson replication.

A source with share of size ``s`` and target weight ``w`` is repeated at the mean rate
``epochs * (w / sum of weights) / s``. Each document draws its own count by inverting the
Poisson distribution at a uniform number hashed from the seed and its id, so a rerun or a
lost executor draws the same counts. A rate over ``LIMIT`` is the sum of equal rates below
it, each drawn for itself, so that the work of a draw follows the copies it makes. Documents
are then exploded by their count and dealt to partitions by a hash of document and copy, in
hash order within each; the number of partitions follows from the bytes to be written.

All expressions are built in. Only per-source totals are aggregated; they are joined, not
collected, and a source with a third of all rows is joined by a splittable join.

Null sources form a source of their own. Null text has size 0 and is drawn like any other.
Sources without a weight take ``default_weight``. If all sizes are 0, rates are 0. Repeated
rows of one id draw the same count. A document without an id draws by its text and its
other columns, so only rows that are equal throughout draw the same. All columns pass
through; one named ``copy`` is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.staging import stage

#: Standard deviations over the mean at which the inversion ends.
TAIL = 12
#: Largest rate of one draw: exp(-rate) must be a normal number.
LIMIT = 700.0
#: Bytes of text a partition of the result is meant to hold, and copies exploded at once.
PART_BYTES, BLOCK = 64 << 20, 1 << 16


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def inverted(rate: Column, draw: Column) -> Column:
    """The first count whose cumulative Poisson probability exceeds the draw; rates up to
    ``LIMIT``. Probabilities are added from the smallest count."""
    last = F.ceil(rate + TAIL * F.sqrt(rate) + TAIL).cast("int")

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k.cast("double")
        total = state["sum"] + p
        more = state["n"] + (total <= draw).cast("long")
        return F.struct(p.alias("p"), total.alias("sum"), more.alias("n"))

    p = F.exp(-rate)
    start = F.struct(p.alias("p"), p.alias("sum"), (p <= draw).cast("long").alias("n"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step)["n"]


def drawn_count(rate: Column, seed: int, key: Column) -> Column:
    """Copies of the document told by ``key``: one draw, or a sum of draws at high rates."""
    draws = F.greatest(F.ceil(rate / LIMIT).cast("int"), F.lit(1))
    each = rate / draws.cast("double")
    base = F.lit(str(seed))
    first = inverted(each, uniform(base, key))
    more = F.aggregate(
        F.sequence(F.lit(1), draws - 1),
        F.lit(0).cast("long"),
        lambda total, i: total + inverted(each, uniform(base, key, i.cast("string"))),
    )
    some = F.when(draws > 1, first + more).otherwise(first)
    return F.when(rate > 0, some).otherwise(F.lit(0).cast("long"))


def document_key(names: list[str]) -> Column:
    """The id, or for a document without one a digest of all its columns."""
    whole = F.md5(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), whole))


def source_rates(
    docs: DataFrame,
    weights: Mapping[str, float],
    epochs: float = 1.0,
    default_weight: float = 0.0,
    size: Column | None = None,
) -> DataFrame:
    """One row per source: mixed_source, its rate, and the bytes of its text.

    ``size`` (code points of text unless given) says how much a document counts.
    """
    size = F.coalesce(F.length("text") if size is None else size, F.lit(0)).cast("long")
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("mixed_source") == name, F.lit(float(w))).otherwise(weight)
    totals = docs.groupBy(F.col("source").alias("mixed_source")).agg(
        F.sum(size).alias("held"), F.sum(F.octet_length("text")).alias("mixed_bytes")
    )
    totals = totals.withColumn("wanted", weight)
    whole = totals.agg(F.sum("held").alias("all_held"), F.sum("wanted").alias("all_wanted"))
    rate = F.when(
        (F.col("held") > 0) & (F.col("all_wanted") > 0),
        F.lit(float(epochs))
        * (F.col("wanted") / F.col("all_wanted"))
        * (F.col("all_held").cast("double") / F.col("held").cast("double")),
    ).otherwise(0.0)
    # One row of totals, so every row of the (aggregated) sources meets one row.
    return totals.join(F.broadcast(whole)).select(
        "mixed_source", rate.alias("mixed_rate"), "mixed_bytes"
    )


def poisson_mix(
    docs: DataFrame,
    weights: Mapping[str, float],
    seed: int,
    epochs: float = 1.0,
    default_weight: float = 0.0,
) -> DataFrame:
    """``docs`` repeated by drawn counts, with ``copy`` (from 0), globally shuffled."""
    spark = docs.sparkSession
    names = [n for n in docs.columns if n.lower() != "copy"]
    # The document goes along as one struct, so none of its names can clash.
    row = F.struct(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names))).alias("row")
    keyed = docs.select(row, F.col("source").alias("own_source"), document_key(names).alias("key"))
    rates = stage(source_rates(docs, weights, epochs, default_weight), "rates")
    drawn = keyed.join(rates, F.col("own_source").eqNullSafe(F.col("mixed_source")))
    count = drawn_count(F.col("mixed_rate"), seed, F.col("key"))
    copies = drawn.select("row", "key", count.alias("count")).filter(F.col("count") > 0)
    # In blocks, so that no document's copies are one long list.
    copies = copies.withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / BLOCK)))
    )
    low = F.col("block") * BLOCK
    high = F.least(low + BLOCK, F.col("count")) - 1
    copies = copies.select("row", "key", F.explode(F.sequence(low, high)).alias("copy"))
    deal = F.xxhash64(F.lit(seed), "key", "copy")
    copies = copies.select("row", F.col("copy").cast("int"), deal.alias("deal"))
    written = rates.agg(F.sum(F.col("mixed_bytes") * F.col("mixed_rate"))).first()[0] or 0
    parts = max(int(written // PART_BYTES) + 1, spark.sparkContext.defaultParallelism)
    return copies.repartition(parts, "deal").sortWithinPartitions("deal").select(
        *(F.col(f"row.c{i}").alias(n) for i, n in enumerate(names)), "copy"
    )
