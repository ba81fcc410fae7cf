"""A classification forest over a mart of many rows, its trees held as a table.

MLlib makes a histogram of each growing node in each part, however few rows the node has, and
keeps all trees on the driver. Here rows are packed to one small code a column. Nodes of many
rows are split by histograms summed over all parts; the rows of each smaller node then meet in
one task, which grows all that is below it. No task holds more rows than ``NODE_ROWS`` draws,
and the driver only the nodes above.

As in MLlib, a column has at most ``bins`` bins, each tree draws every row by a Poisson
distribution of mean 1, each node looks at features of its own draw, a node without a split that
lowers its Gini impurity is a leaf, and two sibling leaves of the same class become one.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

if TYPE_CHECKING:
    from tillcast.plans.models import ForestSettings

# Tasks get these functions with the job: executors need no more than numpy and pyarrow.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Draws of a node whose rows meet in one task, and rows packed together.
NODE_ROWS, CHUNK = 1 << 22, 1 << 15
# Customers scored by one task for a tree: one more slice for this many rows of the training.
SLICE_ROWS = 1 << 24
# Cells of the histograms a task fills at once.
CELLS = 1 << 23
# Rows of ended nodes are dropped once fewer than this share go on.
STAYING = 0.8
# Counts of all draws and of those of class 1 are summed as one double.
GOOD = float(1 << 26)

BINS_SCHEMA = "position int, column string, cuts array<double>, slots int"
TREES_SCHEMA = "tree int, node long, split int, cut int, good long, total long"
HISTOGRAM_SCHEMA = "tree int, node long, cells binary"
SPLIT_SCHEMA = TREES_SCHEMA + ", left_good long, left_total long, cells binary"


@dataclass(frozen=True)
class Bins:
    """How columns become codes. A number's code counts the cuts below it. A block of
    indicators, of which at most one is 1, has that one's place, or 0."""

    cuts: dict[str, list[float]]
    # Column of the indicators, and the slots of each block.
    vector: str
    blocks: list[int]

    @property
    def columns(self) -> list[str]:
        return [*self.cuts, *[self.vector] * bool(self.blocks)]

    @property
    def widths(self) -> list[int]:
        """Codes of each packed column."""
        return [len(cuts) + 1 for cuts in self.cuts.values()] + [n + 1 for n in self.blocks]

    @property
    def code(self) -> np.dtype:
        return np.min_scalar_type(max(self.widths))

    @property
    def features(self) -> int:
        return len(self.cuts) + sum(self.blocks)

    def inputs(self) -> list[Column]:
        """The numbers, and the place of the 1 in each block."""
        found = [F.col(c).cast("double").alias(f"in_{i}") for i, c in enumerate(self.cuts)]
        first = 1
        for size in self.blocks:
            block = F.slice(vector_to_array(self.vector), first, size)
            place = F.array_position(block, F.lit(1.0)).cast("double")
            found.append(place.alias(f"in_{len(found)}"))
            first += size
        return found

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        """The codes of each row, side by side."""
        found = np.empty((batch.num_rows, len(self.widths)), self.code)
        cuts = [np.asarray(c) for c in self.cuts.values()]
        for i in range(len(self.widths)):
            values = batch.column(f"in_{i}").to_numpy(zero_copy_only=False)
            if np.isnan(values).any():
                raise ValueError(f"{[*self.cuts, self.vector][min(i, len(cuts))]} is NULL or NaN")
            found[:, i] = np.searchsorted(cuts[i], values, "left") if i < len(cuts) else values
        return found

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, cuts, None) for c, cuts in self.cuts.items()]
        rows += [(self.vector, None, n) for n in self.blocks]
        numbered = [(i, *row) for i, row in enumerate(rows)]
        return spark.createDataFrame(numbered, BINS_SCHEMA).coalesce(1)

    @classmethod
    def from_df(cls, df: DataFrame) -> Bins:
        held = sorted(df.collect(), key=lambda r: r["position"])
        numbers = {r["column"]: list(r["cuts"]) for r in held if r["slots"] is None}
        blocks = [r for r in held if r["slots"] is not None]
        return cls(numbers, blocks[0]["column"] if blocks else "", [r["slots"] for r in blocks])

    @classmethod
    def fit(
        cls, train: DataFrame, numbers: Sequence[str], vector: str, blocks: list[int], bins: int
    ) -> Bins:
        """Cuts between all values of a number if these are no more than ``bins``, else at its
        quantiles."""
        values = {c: F.col(c).cast("double") for c in numbers}
        about = train.agg(*[F.approx_count_distinct(v).alias(c) for c, v in values.items()]).first()
        cuts: dict[str, list[float]] = dict.fromkeys(numbers, [])
        many = []
        for c in numbers:
            few = []
            if about[c] <= 2 * bins:
                few = train.select(values[c]).distinct().limit(bins + 1).collect()
            if 0 < len(few) <= bins:
                held = sorted(r[0] for r in few if r[0] is not None)
                cuts[c] = [(a + b) / 2 for a, b in zip(held, held[1:], strict=False)]
            else:
                many.append(c)
        if many:
            shares = [i / bins for i in range(1, bins)]
            row = train.agg(
                *[F.percentile_approx(values[c], shares, 100 * bins).alias(c) for c in many]
            ).first()
            cuts.update({c: sorted(set(row[c] or [])) for c in many})
        return cls(cuts, vector, list(blocks))


@dataclass(frozen=True)
class Growth:
    """What a tree needs to know to grow."""

    widths: list[int]
    numbers: int
    take: int
    depth: int
    seed: int
    bootstrap: bool

    @property
    def features(self) -> int:
        return self.numbers + sum(self.widths[self.numbers :]) - (len(self.widths) - self.numbers)

    @property
    def cells(self) -> list[slice]:
        """Where each column's codes lie in a row of a histogram."""
        ends = np.cumsum(self.widths).tolist()
        return [slice(end - width, end) for end, width in zip(ends, self.widths, strict=True)]

    def draws(self, tree: int, part: int, chunk: int, rows: int) -> np.ndarray:
        """How often a tree takes each row of a chunk."""
        if not self.bootstrap:
            return np.ones(rows, np.uint8)
        source = np.random.Generator(np.random.SFC64([self.seed, tree, part, chunk]))
        return POISSON[np.frombuffer(source.bytes(2 * rows), np.uint16)]

    def looks(self, source: np.random.Generator, nodes: int) -> np.ndarray:
        """The features each node looks at, as a mask."""
        if self.take >= self.features:
            return np.ones((nodes, self.features), bool)
        found = np.zeros((nodes, self.features), bool)
        order = source.random((nodes, self.features)).argpartition(self.take, axis=1)
        np.put_along_axis(found, order[:, : self.take], True, axis=1)
        return found


def _poisson() -> np.ndarray:
    """Draws of mean 1 by 16 random bits."""
    reached = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(reached, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


POISSON = _poisson()


def features_taken(subset: str, features: int) -> int:
    """How many features a node looks at, in MLlib's words."""
    shares = {
        "all": features,
        "auto": math.ceil(math.sqrt(features)),
        "sqrt": math.ceil(math.sqrt(features)),
        "log2": max(1, math.ceil(math.log2(features))),
        "onethird": math.ceil(features / 3),
    }
    if subset in shares:
        return shares[subset]
    number = float(subset)
    return min(features, int(number)) if number >= 1 and "." not in subset else math.ceil(number * features)


def best_splits(
    growth: Growth, held: tuple[np.ndarray, np.ndarray], total: np.ndarray, good: np.ndarray, mask: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Column, cut, and the counts on the left of each node's best split; column -1 for none.

    ``held`` has, for all draws and those of class 1, a row for each node with the codes of all
    columns side by side. The drop of a node's Gini impurity goes with what is compared here.
    """
    nodes = np.arange(len(total))
    best = np.zeros(len(total))
    split, cut = np.full(len(total), -1, np.int32), np.zeros(len(total), np.int32)
    left_total, left_good = np.zeros(len(total)), np.zeros(len(total))
    n, g, first = total[:, None], good[:, None], 0
    for c, cells in enumerate(growth.cells):
        count, hits = (h[:, cells] for h in held)
        if c < growth.numbers:
            looked = mask[:, first : first + 1]
            first += 1
            count, hits = count.cumsum(1)[:, :-1], hits.cumsum(1)[:, :-1]
        else:
            looked = mask[:, first : first + count.shape[1] - 1]
            first += count.shape[1] - 1
            # Rows of the category go right.
            count, hits = n - count[:, 1:], g - hits[:, 1:]
        if not count.shape[1]:
            continue
        room = count * (n - count)
        apart = hits * n - count * g
        apart *= apart
        apart *= looked
        score = np.divide(apart, room, out=np.zeros_like(apart), where=room > 0)
        at = score.argmax(1)
        reached = score[nodes, at]
        better = reached > best
        best[better] = reached[better]
        split[better] = c
        cut[better] = at[better] + (c >= growth.numbers)
        left_total[better] = count[nodes, at][better]
        left_good[better] = hits[nodes, at][better]
    return split, cut, left_total, left_good


def _apart(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all draws and of those of class 1, from their sum as one double."""
    hits = np.floor(both / GOOD)
    return both - hits * GOOD, hits


def _counted(growth: Growth, codes: np.ndarray, both: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
    """The histograms of all columns, a row for each node."""
    held = np.empty((nodes, growth.cells[-1].stop))
    for column, cells, width in zip(codes.T, growth.cells, growth.widths, strict=True):
        place = node * width
        place += column
        held[:, cells] = np.bincount(place, both, nodes * width).reshape(nodes, width)
    return held


def grown(
    growth: Growth, codes: np.ndarray, draws: np.ndarray, label: np.ndarray, root: int, tree: int
) -> list[np.ndarray]:
    """All nodes of the subtree at ``root``: node, split, cut, good, total.

    Nodes are numbered as in a heap: the children of i are 2i and 2i + 1. A level passes once
    over the rows. Histograms are made of the smaller child's rows, the other's are what is left
    of their parent's.
    """
    source = np.random.Generator(np.random.SFC64([growth.seed, tree, root]))
    both = draws * (1.0 + GOOD * label)
    total, good = (np.array([v]) for v in _apart(both.sum()))
    ids, node, held = np.array([root], np.int64), np.zeros(len(both), np.int64), None
    level = root.bit_length() - 1
    if good[0] == 0 or good[0] == total[0] or level >= growth.depth:
        return _pruned([_leaves(ids, good, total)])
    found = []
    step = max(1, CELLS // max(growth.cells[-1].stop, growth.features))
    while len(ids):
        if len(ids) <= step and held is None:
            held = _counted(growth, codes, both, node, len(ids))
        parts = []
        for low in range(0, len(ids), step):
            high = min(low + step, len(ids))
            if held is None:
                rows = np.flatnonzero((node >= low) & (node < high))
                some = _counted(growth, codes[rows], both[rows], node[rows] - low, high - low)
            else:
                some = held
            mask = growth.looks(source, high - low)
            parts.append(best_splits(growth, _apart(some), total[low:high], good[low:high], mask))
        split, cut, left_total, left_good = (np.concatenate(p) for p in zip(*parts, strict=True))
        found.append((ids, split, cut, good, total))
        level += 1
        parent = np.flatnonzero(split >= 0)
        kid_total = np.stack([left_total, total - left_total], 1)[parent].ravel()
        kid_good = np.stack([left_good, good - left_good], 1)[parent].ravel()
        kids = np.stack([2 * ids, 2 * ids + 1], 1)[parent].ravel()
        ended = (kid_good == 0) | (kid_good == kid_total) | (level >= growth.depth)
        found.append(_leaves(kids[ended], kid_good[ended], kid_total[ended]))
        live = np.flatnonzero(~ended)
        nodes, ids, good, total = len(ids), kids[live], kid_good[live], kid_total[live]
        if not len(ids):
            break
        # A row goes right if its code lies so far from the low one; rows of ended nodes stay out.
        low, span, first = (np.full(nodes + 1, v, np.int64) for v in (1 << 40, 0, len(kids)))
        number = split[parent] < growth.numbers
        low[parent] = cut[parent] + number
        span[parent] = np.where(number, 1 << 32, 0)
        first[parent] = 2 * np.arange(len(parent))
        column = np.zeros(nodes + 1, np.int64)
        column[parent] = split[parent]
        at = column[node]
        at += np.arange(0, codes.size, codes.shape[1])
        value = codes.reshape(-1)[at] - low[node]
        kid = first[node] + (value.view(np.uint64) <= span[node].view(np.uint64))
        if held is None or len(ids) > step:
            held = None
        else:
            pairs = kid_total.reshape(-1, 2)
            small = 2 * np.arange(len(parent)) + (pairs[:, 1] < pairs[:, 0])
            rank = np.full(len(kids) + 1, -1, np.int64)
            going = ~ended.reshape(-1, 2).all(1)
            rank[small[going]] = np.arange(going.sum())
            counts = rank[kid]
            rows = np.flatnonzero(counts >= 0)
            less = _counted(
                growth, np.take(codes, rows, axis=0), both[rows], counts[rows], int(going.sum())
            )
            of = np.cumsum(going) - 1
            mine = of[live // 2]
            held = np.where(
                (small[live // 2] == live)[:, None], less[mine], held[parent[live // 2]] - less[mine]
            )
        place = np.full(len(kids) + 1, len(ids), np.int64)
        place[live] = np.arange(len(ids))
        node = place[kid]
        stay = np.flatnonzero(node < len(ids))
        if held is None or len(stay) < STAYING * len(node):
            node, both, codes = node[stay], both[stay], np.take(codes, stay, axis=0)
    return _pruned(found)


def _leaves(ids: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    return ids, np.full(len(ids), -1, np.int32), np.zeros(len(ids), np.int32), good, total


def _pruned(levels: Sequence[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The nodes by number, once sibling leaves of the same class are their parent's."""
    ids, split, cut, good, total = (np.concatenate(p) for p in zip(*levels, strict=True))
    order = ids.argsort()
    ids, split, cut, good, total = (a[order] for a in (ids, split, cut, good, total))
    likely, kept = 2 * good > total, np.ones(len(ids), bool)
    child = np.searchsorted(ids, 2 * ids)
    depth = np.log2(ids).astype(int)
    for level in range(depth.max(), depth.min() - 1, -1):
        inner = np.flatnonzero((depth == level) & (split >= 0))
        left = child[inner]
        same = (split[left] < 0) & (split[left + 1] < 0) & (likely[left] == likely[left + 1])
        split[inner[same]] = -1
        kept[left[same]] = kept[left[same] + 1] = False
    return [a[kept] for a in (ids, split, cut, good, total)]


def _nodes(tree: int, nodes: Sequence[np.ndarray]) -> pa.Table:
    ids, split, cut, good, total = nodes
    return pa.table(
        {
            "tree": np.full(len(ids), tree, np.int32),
            "node": ids,
            "split": split.astype(np.int32),
            "cut": np.where(split >= 0, cut, 0).astype(np.int32),
            "good": good.astype(np.int64),
            "total": total.astype(np.int64),
        }
    )


def packed(df: DataFrame, bins: Bins, label: str | None, carried: Sequence[str] = ()) -> DataFrame:
    """A row for up to ``CHUNK`` rows of a part: their codes, labels and carried columns."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def cut(size: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            first, rest = table.slice(0, size), table.slice(size)
            held[:] = rest.to_batches()
            batch = first.combine_chunks().to_batches()[0]
            with pa.BufferOutputStream() as sink:
                if carried:
                    kept = batch.select(list(carried))
                    with pa.ipc.new_stream(sink, kept.schema) as writer:
                        writer.write_batch(kept)
                keys = sink.getvalue().to_pybytes()
            labels = batch.column("label").to_numpy().astype(np.uint8).tobytes() if label else b""
            record = {
                "part": [part],
                "chunk": [chunk],
                "rows": [batch.num_rows],
                "codes": [bins.codes(batch).tobytes()],
                "label": [labels],
                "keys": [keys],
            }
            schema = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            arrays = [pa.array(v, t) for v, t in zip(record.values(), schema, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=list(record))

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= CHUNK:
                yield cut(CHUNK)
                chunk, rows = chunk + 1, rows - CHUNK
        if rows:
            yield cut(rows)

    labels = [F.col(label).cast("int").alias("label")] if label else []
    chosen = df.select(*bins.inputs(), *labels, *carried)
    schema = "part int, chunk int, rows int, codes binary, label binary, keys binary"
    return chosen.mapInArrow(pack, schema)


def _chunks(batches: Iterator[pa.RecordBatch], bins: Bins):
    for batch in batches:
        for row in batch.to_pylist():
            codes = np.frombuffer(row["codes"], bins.code).reshape(row["rows"], -1)
            yield row["part"], row["chunk"], codes, np.frombuffer(row["label"], np.uint8)


def _above(nodes: set[int]) -> set[int]:
    """The nodes and all above them."""
    found = set()
    for node in nodes:
        while node and node not in found:
            found.add(node)
            node >>= 1
    return found


def _routed(
    growth: Growth,
    codes: np.ndarray,
    rows: np.ndarray,
    tops: dict[int, tuple[int, int]],
    wanted: set[int],
) -> Iterator[tuple[int, np.ndarray]]:
    """The rows that reach each wanted node, by the splits above."""
    way = _above(wanted)
    todo = [(1, rows)]
    while todo:
        node, rows = todo.pop()
        if node in wanted:
            yield node, rows
            continue
        split, cut = tops[node]
        value = codes[:, split][rows]
        right = value > cut if split < growth.numbers else value == cut
        if 2 * node in way:
            todo.append((2 * node, rows[~right]))
        if 2 * node + 1 in way:
            todo.append((2 * node + 1, rows[right]))


@dataclass(frozen=True)
class Counted:
    """A node whose rows are counted in a pass. Its sibling's histogram is what is left of their
    parent's; ``splits`` tells which of the two to split."""

    splits: tuple[int, ...]
    parent: bytes | None = None


def _split_tops(
    rows: DataFrame,
    bins: Bins,
    growth: Growth,
    tops: dict[int, dict[int, tuple[int, int]]],
    counted: dict[tuple[int, int], Counted],
) -> list[Row]:
    """The best splits of the nodes that ask for one, by histograms of all their rows, and these
    histograms."""
    wanted: dict[int, set[int]] = {}
    for tree, node in counted:
        wanted.setdefault(tree, set()).add(node)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for part, chunk, codes, label in _chunks(batches, bins):
            for tree, nodes in wanted.items():
                draws = growth.draws(tree, part, chunk, len(codes))
                taken = np.flatnonzero(draws)
                for node, at in _routed(growth, codes, taken, tops[tree], nodes):
                    both = draws[at] * (1.0 + GOOD * label[at])
                    one = np.zeros(len(at), np.int64)
                    counts = _counted(growth, np.take(codes, at, axis=0), both, one, 1)
                    sums = held.setdefault((tree, node), np.zeros((2, counts.shape[1])))
                    sums += np.concatenate(_apart(counts))
        if held:
            columns = [
                pa.array([t for t, _ in held], pa.int32()),
                pa.array([n for _, n in held], pa.int64()),
                pa.array([cells.tobytes() for cells in held.values()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "cells"])

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        tree, node = (k.as_py() for k in key)
        asked = counted[tree, node]
        own = sum(np.frombuffer(c.as_py(), float) for c in table["cells"])
        found = []
        for one in asked.splits:
            cells = own if one == node else np.frombuffer(asked.parent, float) - own
            held = cells.reshape(2, 1, -1)
            total, good = held[:, :, growth.cells[0]].sum(2)
            source = np.random.Generator(np.random.SFC64([growth.seed, tree, one]))
            looks = growth.looks(source, 1)
            split, cut, left_total, left_good = best_splits(growth, tuple(held), total, good, looks)
            nodes = _nodes(tree, [np.array([one], np.int64), split, cut, good, total])
            left = {"left_good": left_good, "left_total": left_total}
            for name, value in left.items():
                nodes = nodes.append_column(name, [value.astype(np.int64)])
            found.append(nodes.append_column("cells", pa.array([cells.tobytes()], pa.binary())))
        return pa.concat_tables(found)

    found = rows.mapInArrow(fill, HISTOGRAM_SCHEMA).groupBy("tree", "node")
    return found.applyInArrow(choose, SPLIT_SCHEMA).collect()


def _grow_group(
    rows: DataFrame, bins: Bins, growth: Growth, trees: Sequence[int], count: int, path: str
) -> None:
    """Write the nodes of some trees."""
    spark = rows.sparkSession
    tops: dict[int, dict[int, tuple[int, int]]] = {t: {} for t in trees}
    # Nodes above: (tree, node) to split, cut, good, total.
    above: dict[tuple[int, int], list[int]] = {}
    ready: dict[int, set[int]] = {t: set() for t in trees}
    counted: dict[tuple[int, int], Counted] = {}
    if count > NODE_ROWS:
        counted = {(t, 1): Counted((1,)) for t in trees}
    else:
        ready = {t: {1} for t in trees}
    while counted:
        coming: dict[tuple[int, int], Counted] = {}
        for r in _split_tops(rows, bins, growth, tops, counted):
            tree, node = r["tree"], r["node"]
            above[tree, node] = [r["split"], r["cut"], r["good"], r["total"]]
            if r["split"] < 0:
                continue
            tops[tree][node] = (r["split"], r["cut"])
            left = (r["left_good"], r["left_total"])
            right = (r["good"] - left[0], r["total"] - left[1])
            large = []
            for child, (good, total) in ((2 * node, left), (2 * node + 1, right)):
                if good in (0, total) or child.bit_length() - 1 >= growth.depth:
                    above[tree, child] = [-1, 0, good, total]
                elif total > NODE_ROWS:
                    large.append(child)
                else:
                    ready[tree].add(child)
            if large:
                smaller = 2 * node + (right[1] < left[1])
                coming[tree, smaller] = Counted(tuple(large), bytes(r["cells"]))
        counted = coming

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunk, codes, label in _chunks(batches, bins):
            for tree, nodes in ready.items():
                draws = growth.draws(tree, part, chunk, len(codes))
                taken = np.flatnonzero(draws)
                here = [
                    (node, np.take(codes, at, axis=0).tobytes() + (2 * draws[at] + label[at]).tobytes())
                    for node, at in _routed(growth, codes, taken, tops[tree], nodes)
                    if len(at)
                ]
                columns = [
                    pa.array([tree] * len(here), pa.int32()),
                    pa.array([node for node, _ in here], pa.int64()),
                    pa.array([held for _, held in here], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "rows"])

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        tree, node = (k.as_py() for k in key)
        size = len(growth.widths) * bins.code.itemsize + 1
        codes, drawn = [], []
        for held in table["rows"]:
            raw = held.as_buffer()
            many = raw.size // size
            codes.append(
                np.frombuffer(raw, bins.code, many * len(growth.widths)).reshape(many, -1)
            )
            drawn.append(np.frombuffer(raw, np.uint8, many, raw.size - many))
        drawn = np.concatenate(drawn)
        codes = np.concatenate(codes)
        return _nodes(tree, grown(growth, codes, drawn >> 1, drawn & 1, node, tree))

    groups = [(t, n) for t, nodes in ready.items() for n in sorted(nodes)]
    if groups:
        dealt = rows.mapInArrow(deal, "tree int, node long, rows binary")
        meet = dealt.repartition(len(groups), "tree", "node").groupBy("tree", "node")
        meet.applyInArrow(grow, TREES_SCHEMA).write.mode("append").parquet(path)
    if not above:
        return
    known = dict(above)
    if groups:
        met = spark.createDataFrame(groups, "tree int, node long")
        nodes = spark.read.schema(TREES_SCHEMA).parquet(path)
        for r in nodes.join(F.broadcast(met), ["tree", "node"]).collect():
            known[r["tree"], r["node"]] = [r["split"], r["cut"], r["good"], r["total"]]
    # From the lowest up; what lies below a joined node is never reached.
    for tree, node in sorted(above, key=lambda k: -k[1]):
        if known[tree, node][0] >= 0:
            a, b = known[tree, 2 * node], known[tree, 2 * node + 1]
            if a[0] < 0 and b[0] < 0 and (2 * a[2] > a[3]) == (2 * b[2] > b[3]):
                known[tree, node][0] = -1
    top = [(*k, *known[k]) for k in above]
    spark.createDataFrame(top, TREES_SCHEMA).coalesce(1).write.mode("append").parquet(path)


@dataclass(frozen=True)
class TreeTable:
    """A fitted forest: how columns become codes, and a row for each node of each tree."""

    bins: Bins
    nodes: DataFrame
    trees: int
    slices: int

    @property
    def columns(self) -> list[str]:
        return self.bins.columns

    def to_df(self, spark: SparkSession) -> DataFrame:
        return self.nodes.repartition("tree")

    def transform(self, df: DataFrame) -> DataFrame:
        """The columns that the forest does not read, and ``probability``: the mean over all
        trees of the share of class 1 in the leaf a row reaches.

        Each tree meets the packed rows in a task of its own.
        """
        carried = [c for c in df.columns if c not in self.columns]
        bins = self.bins
        schema = StructType([*df.select(*carried).schema, StructField("probability", DoubleType())])
        # Sorted, so that a repeated task packs the same rows together.
        chunks = packed(df.sortWithinPartitions(*carried), bins, None, carried)
        chunk = F.concat_ws("-", "part", "chunk").alias("chunk")
        rows = chunks.select(
            chunk, "codes", "keys", "rows", F.explode(F.lit(list(range(self.trees)))).alias("tree")
        ).select(
            "tree",
            F.pmod(F.hash("chunk"), F.lit(self.slices)).alias("slice"),
            "chunk",
            "codes",
            "rows",
            # Carried once, not with each tree.
            F.when(F.col("tree") == 0, F.col("keys")).alias("keys"),
        )
        nodes = self.nodes.select("*", F.explode(F.lit(list(range(self.slices)))).alias("slice"))

        def walk(rows: pa.Table, nodes: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return rows.select(["chunk", "tree", "keys", "codes"]).rename_columns(
                    ["chunk", "tree", "keys", "shares"]
                )
            order = nodes["node"].to_numpy().argsort()
            ids, split, cut, good, total = (
                nodes[c].to_numpy()[order] for c in ("node", "split", "cut", "good", "total")
            )
            child, share = np.searchsorted(ids, 2 * ids), good / total
            found = []
            for raw, many in zip(rows["codes"], rows["rows"].to_pylist(), strict=True):
                codes = np.frombuffer(raw.as_buffer(), bins.code).reshape(many, -1)
                place, going = np.zeros(many, np.int64), np.arange(many)
                while len(going := going[split[place[going]] >= 0]):
                    at = place[going]
                    value = codes[going, split[at]]
                    right = np.where(split[at] < len(bins.cuts), value > cut[at], value == cut[at])
                    place[going] = child[at] + right
                found.append(share[place].tobytes())
            return rows.select(["chunk", "tree", "keys"]).append_column(
                "shares", pa.array(found, pa.binary())
            )

        def mean(table: pa.Table) -> pa.Table:
            table = table.sort_by("tree")
            shares = sum(np.frombuffer(s.as_py(), float) for s in table["shares"]) / table.num_rows
            keys = next(k for k in table["keys"] if k.is_valid)
            held = pa.ipc.open_stream(keys.as_buffer()).read_all()
            return held.append_column("probability", [shares])

        shares = (
            rows.groupBy("tree", "slice")
            .cogroup(nodes.groupBy("tree", "slice"))
            .applyInArrow(walk, "chunk string, tree int, keys binary, shares binary")
        )
        return shares.groupBy("chunk").applyInArrow(mean, schema)


def fit_wide_forest(
    train: DataFrame,
    numbers: Sequence[str],
    vector: str,
    blocks: list[int],
    label: str,
    settings: ForestSettings,
    keys: Sequence[str],
    rows: int,
    seed: int,
    path: str,
) -> TreeTable:
    """Grow the trees, group by group side by side; packed rows and nodes go below ``path``.

    Rows are dealt to parts by key and sorted, so they, the parts and the seed fix the forest.
    """
    spark = train.sparkSession
    bins = Bins.fit(train, numbers, vector, blocks, settings.bins)
    take = features_taken(settings.subset, bins.features)
    growth = Growth(bins.widths, len(bins.cuts), take, settings.depth, seed, settings.bootstrap)
    dealt = train.repartition(settings.parts(rows), *keys)
    dealt = dealt.sortWithinPartitions(*keys, label, *numbers, *[F.hash(vector)] * bool(blocks))
    packed(dealt, bins, label).drop("keys").write.parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows")
    shares = settings.shares(rows)
    last = np.cumsum(shares)

    def grow(i: int) -> None:
        trees = range(int(last[i]) - shares[i], int(last[i]))
        _grow_group(held, bins, growth, trees, rows, f"{path}/nodes/{i}")

    with ThreadPoolExecutor(len(shares)) as pool:
        list(pool.map(inheritable_thread_target(spark)(grow), range(len(shares))))
    nodes = spark.read.schema(TREES_SCHEMA).parquet(*[f"{path}/nodes/{i}" for i in range(len(shares))])
    return TreeTable(bins, nodes, sum(shares), slices(rows))


def slices(rows: int) -> int:
    return 1 + rows // SLICE_ROWS
