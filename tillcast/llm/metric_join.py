"""Exact range join of embeddings under a metric, by pivots.

Vectors are brought to length one, where cosine >= c means a Euclidean distance of at most
r = sqrt(2 - 2c). Each label has pivots, taken from its own vectors by hash. A vector's
home is the cell of its nearest pivot. By the triangle inequality a vector can be within r
of a member of another cell only if its distance to that cell's pivot exceeds its distance
to its own by 2r at most; the half-space between the two pivots gives a second bound.
Vectors are copied into exactly those cells, and each cell is joined by itself: its home
members meet all its members, so each link is seen once from either side. A cell is joined
in pairs of blocks, so its size is no task's size.

Equal vectors of a label are one vector first, with their number; a common vector costs no
more than a rare one. Pairs never leave a task: a task returns link counts and, for
components, a spanning forest of what it saw.

Cosine is computed in double precision. Vectors that are null, empty, zero, or hold null or
non-finite parts, and those with a null label, link with nothing, keep their row and are
their own component; so do vectors of different lengths with each other. Repeated vec_ids
are rows of their own. A row without vec_id links like others and is never smallest while
another row is in its component. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.components import components
from tillcast.staging import stage

#: Rows for which a label has a pivot, and about the most pivots of a label; more rows make
#: larger cells, which are joined in more blocks. Rows of a block.
CELL, PIVOTS, BLOCK = 2048, 256, 2048
#: Slack for rounding in the choice of cells; links have none.
SLACK = 1e-9
GROUP = ["label", "size"]


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector in doubles (null if it links with nothing), size and a 128-bit
    address of label and vector."""
    vector = F.col("embedding").cast("array<double>")
    fit = (
        F.col("label").isNotNull()
        & (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
        & F.exists(vector, lambda x: x != 0)
    )
    # Zero has two signs; equal vectors must have equal bytes.
    plain = F.transform(vector, lambda x: x + F.lit(0.0))
    return embeddings.select(
        F.col("vec_id").cast("long"), "label", F.when(fit, plain).alias("vector")
    ).select(
        "*",
        F.size("vector").alias("size"),
        F.xxhash64("label", "vector").alias("v1"),
        F.xxhash64(F.lit(1), "label", "vector").alias("v2"),
    )


def _unit(vectors: pd.Series) -> np.ndarray:
    points = np.stack(vectors.to_list())
    # Dividing by the largest part first keeps squares in range.
    points = points / np.abs(points).max(axis=1, keepdims=True)
    return points / np.sqrt((points * points).sum(axis=1, keepdims=True))


def cells(anchors: np.ndarray, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each point, and which cells may have home members within ``reach``."""
    near = points @ anchors.T
    home = near.argmax(axis=1)
    rows = np.arange(len(points))
    best = near[rows, home]
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (anchors @ anchors.T)))
    # Distance of the point to the half-space between the two pivots, times their distance.
    within = best[:, None] - near <= reach * apart[home] + SLACK
    far, own = np.sqrt(np.maximum(0, 2 - 2 * near)), np.sqrt(np.maximum(0, 2 - 2 * best))
    within &= far - own[:, None] <= 2 * reach + SLACK
    within[rows, home] = True
    return home, within


def _placed(vectors: DataFrame, reach: float, cell_rows: int, pivots: int) -> DataFrame:
    """A row for each cell a vector goes to: node, n, vector, cell and whether it is home."""
    turn = F.xxhash64("v1", "v2")
    groups = vectors.groupBy(GROUP).agg(
        F.count("*").alias("rows"), F.min(F.struct(turn, "node")).getField("node").alias("one")
    )
    groups = stage(groups, "groups")
    wanted = F.least(F.lit(pivots), F.ceil(F.col("rows") / cell_rows))
    share = (turn.cast("double") / 2.0**64 + 0.5) * F.col("rows") < wanted
    salted = vectors.join(groups, GROUP).select(
        *GROUP, "node", "n", "vector",
        ((F.col("rows") > cell_rows) & share | (F.col("node") == F.col("one"))).alias("pivot"),
        F.ceil(F.col("rows") / 1024).cast("int").alias("salts"),
    ).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    salted = stage(salted, "salted")
    anchors = salted.filter("pivot").select(
        *GROUP, "node", "vector", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )

    def place(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in (*GROUP, "cell", "home", "node", "n", "vector")})
        anchors = anchors.sort_values("node")
        home, within = cells(_unit(anchors["vector"]), _unit(rows["vector"]), reach)
        row, cell = np.nonzero(within)
        out = rows[[*GROUP, "node", "n", "vector"]].iloc[row].reset_index(drop=True)
        out["cell"], out["home"] = cell.astype(np.int32), home[row] == cell
        return out

    keys = [*GROUP, "salt"]
    kind = dict(vectors.dtypes)["label"]
    return salted.groupBy(keys).cogroup(anchors.groupBy(keys)).applyInPandas(
        place,
        f"label {kind}, size int, cell int, home boolean, node long, n long, vector array<double>",
    )


def _linked(one: np.ndarray, two: np.ndarray, least: float) -> np.ndarray:
    """Which rows of both have a cosine of at least ``least``."""
    cosine = one @ two.T
    linked = cosine >= least
    # Where rounding could decide, sum in one fixed order.
    for i, j in np.argwhere(np.abs(cosine - least) < 1e-12):
        linked[i, j] = math.fsum(one[i] * two[j]) >= least
    return linked


def _joiner(least: float):
    def join(block: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = block[block["side"] == 0], block[block["side"] == 1]
        if not (len(ours) and len(theirs)):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        linked = _linked(_unit(ours["vector"]), _unit(theirs["vector"]), least)
        a, b = ours["node"].to_numpy(), theirs["node"].to_numpy()
        linked &= a[:, None] != b[None, :]
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        at_a, at_b = place[: len(a)], place[len(a) :]
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, at_a, linked @ theirs["n"].to_numpy(np.int64))
        tree = np.arange(len(nodes))
        for i in np.flatnonzero(linked.any(axis=1)):
            met = np.unique(tree[np.append(at_b[linked[i]], at_a[i])])
            if len(met) > 1:
                tree[np.isin(tree, met[1:])] = met[0]
        touched = (links > 0) | (tree != np.arange(len(nodes)))
        return pd.DataFrame(
            {"node": nodes[touched], "links": links[touched], "root": nodes[tree[touched]]}
        )

    return join


def range_links(vectors: DataFrame, least: float, cell_rows: int, pivots: int, block: int) -> DataFrame:
    """For each node with links seen in a block: node, links, and a node it hangs together
    with. ``vectors``: label, size, node, n, vector, v1, v2."""
    placed = stage(_placed(vectors, math.sqrt(max(0.0, 2 - 2 * least)), cell_rows, pivots), "placed")
    keys = [*GROUP, "cell"]
    counts = placed.groupBy(keys).agg(
        F.ceil(F.count_if("home") / block).cast("int").alias("i"),
        F.ceil(F.count("*") / block).cast("int").alias("j"),
    )
    counts = stage(counts, "counts")
    every = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(1), F.col(n)) - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.col(n))).cast("int")
    sized = placed.join(counts, keys)
    home = sized.filter("home").select(
        *keys, own("i").alias("a"), F.explode(every("j")).alias("b"), F.lit(0).alias("side"),
        "node", "n", "vector",
    )
    members = sized.select(
        *keys, F.explode(every("i")).alias("a"), own("j").alias("b"), F.lit(1).alias("side"),
        "node", "n", "vector",
    )
    return home.unionByName(members).groupBy(*keys, "a", "b").applyInPandas(
        _joiner(least), "node long, links long, root long"
    )


def metric_components(
    embeddings: DataFrame,
    least: float = 0.98,
    cell_rows: int = CELL,
    pivots: int = PIVOTS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept."""
    rows = stage(usable(embeddings), "vectors")
    fit = rows.filter(F.col("vector").isNotNull())
    nodes = fit.groupBy("v1", "v2").agg(
        *(F.first(c).alias(c) for c in (*GROUP, "vector")),
        F.count("*").alias("n"),
        F.min("vec_id").alias("first_id"),
    )
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    seen = stage(range_links(nodes, least, cell_rows, pivots, block), "seen")
    totals = seen.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(seen.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = (
        nodes.select("v1", "v2", "node", "n", "first_id")
        .join(totals, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    rooted = stage(rooted, "rooted")
    smallest = stage(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
    told = rooted.join(smallest, "root").select(
        "v1", "v2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        "component_id",
    )
    told = stage(told, "told")
    known = rows.withColumn("fit", F.col("vector").isNotNull()).drop("vector")
    joined = known.join(told.withColumn("fit", F.lit(True)), ["v1", "v2", "fit"], "left")
    component = F.when(F.col("fit"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
