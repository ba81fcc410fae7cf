"""Connected components of a graph of links, by alternating stars.

Each pass hangs every node's neighbours on the smallest node it knows, first for larger
neighbours, then for smaller ones. The number of edges does not grow, chains shorten by a
constant factor, and in the end every node hangs on its component's smallest node. Minima
are taken by aggregation and joined back from written tables, so that a node with a third
of all edges is spread over tasks; no neighbourhood is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.staging import stage


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has no other neighbour at all."""
    up = edges.select(F.col("a").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger"))
    down = edges.select(F.col("b").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger"))
    ends = up.unionByName(down).groupBy("node").agg(
        F.sum("smaller").alias("smaller"), F.max("larger").alias("larger")
    )
    odd = F.count_if(F.expr("smaller > 1 OR smaller = 1 AND larger = 1"))
    return not ends.agg(odd).first()[0]


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``links`` (columns a and b, any sortable type).

    Links of a node with itself are ignored; nodes without other links are not returned.
    Repeated links count once. No links give an empty result.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    edges = stage(
        links.select(larger.alias("a"), smaller.alias("b")).filter("a != b").distinct(), "edges"
    )
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        least = stage(least, "least")
        # Large star: larger neighbours of a node go to the smallest of its neighbourhood.
        hung = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), "low")
        edges = stage(hung.select("a", F.col("low").alias("b")).distinct(), "edges")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = stage(edges.groupBy("a").agg(F.min("b").alias("low")), "least")
        moved = edges.join(least, "a").filter("b != low").select(F.col("b").alias("a"), "low")
        edges = stage(
            moved.unionByName(least).select("a", F.col("low").alias("b")).distinct(), "edges"
        )
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
