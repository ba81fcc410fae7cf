"""Removing passages that occur more than once, by suffix automata of reference shards.

A window is ``window`` consecutive words of one document; a window whose words also start
anywhere else is repeated, and its words go. Comparing everything with everything is
avoided by routing:

1. Each window has a routing key, the smallest hashes of the word runs in it (one at the
   first level). Equal windows have equal keys. Neighbouring windows with one key form a
   piece, so a text is cut into pieces that overlap by a window less a word.
2. A key that routes one piece in the whole corpus, and whose word run comes once in that
   piece, can hold no repetition; such pieces are dropped by a count.
3. The remaining pieces of a key, each different one once with its number of occurrences,
   are a reference shard. Its task builds the suffix automaton, carries occurrence counts
   up the suffix links, and streams the pieces through it: the matching statistic at a
   word is the longest suffix there with two occurrences. Spans of at least the window's
   length are repeated.
4. A shard over ``shard_words`` words is not built. Its pieces are cut again by keys of
   more hashes, down to single windows that are alone with their copies, so no task is
   unbounded and nothing is dropped.

An automaton goes to the pieces of its key by a shuffle, not to all tasks by broadcast: the
automata of a corpus grow with it, and each text would have to pass all of them.

Texts are addressed by a 128-bit hash of their whole content; copies share one answer and
count as often as they occur. Null text has no words. Repeated rows and null doc_ids keep
a row each (as copies, so all their windows are repeated). Texts shorter than a window
stay whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.words import grams, hashes, mixed, slices, split
from tillcast.staging import stage

#: Words of a window, of the runs whose hashes route it, and of the largest shard.
WINDOW, RUN, SHARD_WORDS = 35, 8, 8_000


def with_key(docs: DataFrame) -> DataFrame:
    """``text`` (null as empty) with a 128-bit address, k1 and k2."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("text", text).withColumns(
        {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")}
    )


def route(words: np.ndarray, begins: np.ndarray, window: int, run: int, depth: int):
    """Pieces of all texts: row, first word, number of windows, key, and whether the piece
    may repeat something in itself. At full depth each window is a piece."""
    hashed = grams(words, run)
    width = window - run + 1
    n = len(hashed) - width + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64), empty.astype(bool)
    if depth == 1:
        # The smallest of ``width`` neighbours, by doubling.
        key, reach = hashed, 1
        while reach < width:
            step = min(reach, width - reach)
            key = np.minimum(key[: len(key) - step], key[step:])
            reach += step
    else:
        near = np.lib.stride_tricks.sliding_window_view(hashed, width)
        low = np.sort(near, axis=1)[:, :depth]
        key = np.zeros(n, dtype=np.uint64)
        for column in low.T:
            key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(depth)
    row = np.searchsorted(begins, np.arange(n), "right") - 1
    whole = np.arange(n) + window <= begins[row + 1]
    first = np.ones(n, dtype=bool)
    if depth < width:
        first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
    first &= whole
    at = np.flatnonzero(first)
    counted = np.concatenate([[0], np.cumsum(whole)])
    windows = counted[np.append(at[1:], n)] - counted[at]
    if depth > 1:
        return row[at], at - begins[row[at]], windows, key[at], np.ones(len(at), dtype=bool)
    # Does the run of the key come again within the piece?
    order = np.argsort(hashed, kind="stable")
    again = np.full(len(hashed), len(hashed))
    same = hashed[order[1:]] == hashed[order[:-1]]
    again[order[:-1][same]] = order[1:][same]
    view = np.lib.stride_tricks.sliding_window_view(hashed, width)
    place = at + view[at].argmin(axis=1)
    twice = again[place] < at + windows - 1 + width
    return row[at], at - begins[row[at]], windows, key[at], twice


def _keys(texts: DataFrame, window: int, run: int, depth: int) -> DataFrame:
    """For each text the keys of its pieces and how often they may repeat something."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, begins = split(batch.column("text"))
            row, _, _, key, twice = route(hashes(words), begins, window, run, depth)
            times = np.asarray(batch.column("n"))[row] + twice
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1").take(pa.array(row)),
                    batch.column("k2").take(pa.array(row)),
                    pa.array(key.view(np.int64)),
                    pa.array(times, pa.int64()),
                ],
                ["k1", "k2", "shard", "times"],
            )

    return texts.select("k1", "k2", "text", "n").mapInArrow(
        cut, "k1 long, k2 long, shard long, times long"
    )


def _pieces(texts: DataFrame, window: int, run: int, depth: int) -> DataFrame:
    """Pieces of the shards a text names: its key, the piece's place and words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, begins = split(batch.column("text"))
            row, at, windows, key, _ = route(hashes(words), begins, window, run, depth)
            shards = batch.column("shards")
            wanted = np.asarray(shards.flatten()).view(np.uint64)
            owner = np.repeat(np.arange(len(shards)), np.diff(np.asarray(shards.offsets)))
            # Row and key in one number; a chance clash only adds a piece.
            pair = key ^ mixed(row.astype(np.uint64))
            take = np.flatnonzero(np.isin(pair, wanted ^ mixed(owner.astype(np.uint64))))
            plain = words.to_pylist()
            first = begins[row[take]] + at[take]
            last = first + windows[take] + window - 1
            texts_ = [" ".join(plain[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            rows = pa.array(row[take])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1").take(rows),
                    batch.column("k2").take(rows),
                    batch.column("n").take(rows),
                    pa.array(at[take], pa.int32()),
                    pa.array(key[take].view(np.int64)),
                    pa.array(texts_, pa.string()),
                ],
                ["k1", "k2", "n", "at", "shard", "piece"],
            )

    return texts.mapInArrow(
        cut, "k1 long, k2 long, n long, at int, shard long, piece string"
    ).withColumns({"p1": F.xxhash64("piece"), "p2": F.xxhash64(F.lit(1), "piece")})


class SuffixAutomaton:
    """Automaton of all factors of several word sequences, with occurrence counts."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def _clone(self, state: int, word, old: int) -> int:
        copy = self._state(self.length[state] + 1, self.next[old].copy(), self.link[old])
        self.link[old] = copy
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: Iterable, weight: int) -> list[int]:
        """Add a sequence that occurs ``weight`` times; the states of its prefixes."""
        last, path = 0, []
        for word in words:
            known = self.next[last].get(word)
            if known is not None:
                if self.length[known] != self.length[last] + 1:
                    known = self._clone(last, word, known)
                last = known
            else:
                new, state = self._state(self.length[last] + 1, {}, 0), last
                while state >= 0 and word not in self.next[state]:
                    self.next[state][word] = new
                    state = self.link[state]
                if state >= 0:
                    other = self.next[state][word]
                    if self.length[other] != self.length[state] + 1:
                        other = self._clone(state, word, other)
                    self.link[new] = other
                last = new
            self.count[last] += weight
            path.append(last)
        return path

    def repeated(self) -> list[int]:
        """For each state the length of its longest suffix with two occurrences or more."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(order):
            self.count[self.link[state]] += self.count[state]
        longest = [0] * len(self.length)
        for state in order:
            longest[state] = (
                self.length[state] if self.count[state] > 1 else longest[self.link[state]]
            )
        return longest


def repeated_spans(pieces: list[tuple[str, int]], window: int) -> list[list[tuple[int, int]]]:
    """Word spans of each piece of a shard that lie in repeated windows."""
    automaton = SuffixAutomaton()
    paths = [automaton.add(text.split(" "), weight) for text, weight in pieces]
    longest = automaton.repeated()
    found = []
    for path in paths:
        spans: list[tuple[int, int]] = []
        for i, state in enumerate(path):
            if min(i + 1, longest[state]) >= window:
                if spans and spans[-1][1] >= i + 1 - window:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((i + 1 - window, i + 1))
        found.append(spans)
    return found


VERDICT = "p1 long, p2 long, spans array<struct<a:int,b:int>>"
SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _verdicts(pieces: DataFrame, window: int) -> DataFrame:
    """Repeated spans of the pieces; the partitions hold whole shards in order."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row
            for batch in batches
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)
        )
        for _, shard in groupby(rows, key=lambda r: r[0]):
            members = list(shard)
            spans = repeated_spans([(r[3], r[4]) for r in members], window)
            told = [(r[1], r[2], s) for r, s in zip(members, spans, strict=True) if s]
            if told:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([t[0] for t in told], pa.int64()),
                        pa.array([t[1] for t in told], pa.int64()),
                        pa.array([[dict(a=a, b=b) for a, b in t[2]] for t in told], SPANS),
                    ],
                    ["p1", "p2", "spans"],
                )

    return (
        pieces.select("shard", "p1", "p2", "piece", "n")
        .repartition("shard")
        .sortWithinPartitions("shard", "p1", "p2")
        .mapInArrow(judge, VERDICT)
    )


def _repeated(rows: DataFrame, window: int, run: int, depth: int, shard_words: int) -> DataFrame:
    """k1, k2 and repeated word spans of ``rows`` (k1, k2, text, n occurrences each)."""
    keys = stage(_keys(rows, window, run, depth), "keys")
    shared = keys.groupBy("shard").agg(F.sum("times").alias("times")).filter("times > 1")
    # Written down, so that the join below can split a key with many pieces.
    shared = stage(shared.select("shard"), "shared")
    wanted = (
        keys.join(shared, "shard")
        .groupBy("k1", "k2")
        .agg(F.collect_set("shard").alias("shards"))
    )
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.sum("n").alias("n"))
    placed = stage(_pieces(texts.join(wanted, ["k1", "k2"]), window, run, depth), "pieces")
    whole = placed.groupBy("shard", "p1", "p2").agg(
        F.sum("n").alias("n"), F.first("piece").alias("piece")
    )
    whole = stage(whole, "shards")
    sizes = whole.groupBy("shard").agg(
        F.sum(F.length("piece") - F.length(F.translate("piece", " ", "")) + 1).alias("words")
    )
    large = stage(sizes.filter(F.col("words") > shard_words).select("shard"), "large")
    deepest = depth >= window - run + 1
    if deepest or large.isEmpty():
        verdicts = _verdicts(whole, window)
    else:
        verdicts = _verdicts(whole.join(large, "shard", "left_anti"), window)
        rest = whole.join(large, "shard").select(
            F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("piece").alias("text"), "n"
        )
        # A piece has one key, so no piece comes from two shards.
        deeper = _repeated(stage(rest, "rest"), window, run, depth * 4, shard_words)
        verdicts = verdicts.unionByName(
            deeper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "spans")
        )
    moved = F.transform(
        "spans",
        lambda s: F.struct(
            (s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b")
        ),
    )
    return (
        placed.select("k1", "k2", "at", "p1", "p2")
        .join(verdicts, ["p1", "p2"])
        .groupBy("k1", "k2")
        .agg(F.array_distinct(F.flatten(F.collect_set(moved))).alias("spans"))
    )


def repeated_text_spans(
    docs: DataFrame, window: int = WINDOW, run: int = RUN, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """k1, k2 and ``spans`` of words (start, end exclusive) for texts with repetitions."""
    rows = with_key(docs.select("text")).withColumn("n", F.lit(1).cast("long"))
    return stage(_repeated(rows, window, run, 1, shard_words), "repeated")


def remove_repeated(
    docs: DataFrame,
    window: int = WINDOW,
    run: int = RUN,
    shard_words: int = SHARD_WORDS,
    with_text: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and ``kept``,
    the words that stay, joined by a space (null unless ``with_text``)."""
    spans = repeated_text_spans(docs, window, run, shard_words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple[int, int, str, str]] = []
            texts, spans_ = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            for text, found in zip(texts, spans_, strict=True):
                words = text.encode().split()
                total = len(words)
                if found:
                    stays = np.ones(total, dtype=bool)
                    for s in found:
                        stays[s["a"] : s["b"]] = False
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                kept = b" ".join(words)
                digest = hashlib.sha256(kept).hexdigest()
                text = kept.decode() if with_text else None
                out.append((total, total - len(words), digest, text))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.int64()),
                    pa.array([o[2] for o in out], pa.string()),
                    pa.array([o[3] for o in out], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    rows = with_key(docs.select(F.col("doc_id").cast("long"), "text"))
    return (
        rows.join(spans, ["k1", "k2"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(
            keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
        )
    )
