"""A quality classifier from heuristic labellers that disagree.

Labellers look at one trait each and vote good or bad, see nothing, or can't tell. How the
votes of all documents fall together is counted; from these counts expectation-maximisation
estimates what each labeller says of good and of bad documents, hence its accuracy, and the
chance that a document with given votes is good. No given label is used. A linear scorer
over hashed word shapes then learns these chances on a bounded sample and scores every
text, so it also judges texts on which no labeller votes.

Votes are counted over all documents; at most 4 to the power of the labellers' number of
counts reach the driver. ``sample`` bounds the rows the scorer is fitted on: documents
whose hash is below the share that gives about so many; at most twice as many are taken.

A text without words is rejected. Without any text to fit on, the scorer knows nothing and
keeps every text with words. Repeated rows keep a row each and count as often. An empty
table gives an empty result. Other columns pass through ``keep_good`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.words import grams, hashes, mixed, slices, split
from tillcast.staging import stage

#: Buckets of the hashed features, rows the scorer is fitted on, least chance of good.
BUCKETS, SAMPLE, LEAST = 4096, 20_000, 0.2
#: Votes: bad, good, looked and saw nothing, can't tell.
BAD, GOOD, NONE, SKIP = 0, 1, 2, 3
TRAITS = ("words", "symbols", "capitals", "marks", "stops", "chars", "repeats", "echoes")
PATTERNS = {
    "symbols": r"[#*$%&|<>{}~^\\]",
    "capitals": r"[A-Z]",
    "marks": r"[!?]",
    "stops": r"[.]$",
}


#: Labellers that can't tell in a text of fewer than 20 words unless they see it bad.
NEED_LENGTH = (2, 4, 6, 7)


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[begins[1:]] - total[begins[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Whether each key came before."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


def profile(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Traits of each text, and its hashed features: first place of each text in the lists
    of buckets and of shares."""
    words, begins = split(texts)
    rows = np.repeat(np.arange(len(texts)), np.diff(begins))
    coded = words.dictionary_encode()
    known, code = coded.dictionary, np.asarray(coded.indices)
    traits = {"words": np.diff(begins)}
    for name, pattern in PATTERNS.items():
        found = pc.count_substring_regex(known, pattern).to_numpy(zero_copy_only=False)
        traits[name] = _sums(found[code] if len(code) else code, begins)
    sizes = pc.utf8_length(known).to_numpy(zero_copy_only=False)
    traits["chars"] = _sums(sizes[code] if len(code) else code, begins)
    hashed = hashes(known)[code] if len(code) else np.empty(0, np.uint64)
    runs = grams(hashed, 3)
    inside = rows[: len(runs)] == rows[2:] if len(runs) else np.empty(0, bool)
    again = np.zeros(len(words), dtype=bool)
    again[: len(runs)] = _repeats(runs ^ mixed(rows[: len(runs)].astype(np.uint64))) & inside
    traits["repeats"] = _sums(again, begins)
    echo = np.zeros(len(words), dtype=bool)
    echo[1:] = (hashed[1:] == hashed[:-1]) & (rows[1:] == rows[:-1])
    traits["echoes"] = _sums(echo, begins)
    # Shapes: runs of small letters, capitals and digits become one sign each.
    shape = known
    for pattern, sign in ((r"\p{Ll}+", "x"), (r"\p{Lu}+", "X"), (r"\d+", "9")):
        shape = pc.replace_substring_regex(shape, pattern, sign)
    bucket = (hashes(shape) % np.uint64(BUCKETS - 2)).astype(np.int64) + 2
    place = bucket[code] if len(code) else code.astype(np.int64)
    # Two buckets tell repeated runs and echoes; shapes have the others.
    cell = np.concatenate([rows * BUCKETS + place, rows[again] * BUCKETS, rows[echo] * BUCKETS + 1])
    cells, times = np.unique(cell, return_counts=True)
    owner, buckets = cells // BUCKETS, cells % BUCKETS
    share = times / np.maximum(1, traits["words"])[owner]
    return traits, np.searchsorted(owner, np.arange(len(texts) + 1)), buckets, share


def votes(traits: dict[str, np.ndarray]) -> np.ndarray:
    """A column of votes for each labeller."""
    n = np.maximum(1, traits["words"])
    symbols, marks = traits["symbols"] / n, traits["marks"] / n
    capitals = traits["capitals"] / np.maximum(1, traits["chars"])
    repeats, echoes, stops = traits["repeats"] / n, traits["echoes"] / n, traits["stops"] / n
    enough = traits["words"] >= 20
    bad = [
        symbols > 0.1,
        symbols * n / np.maximum(1, traits["chars"]) > 0.02,
        repeats > 0.3,
        echoes > 0.1,
        capitals > 0.3,
        marks > 0.3,
        np.zeros(len(n), dtype=bool),
        enough & ((traits["chars"] / n < 2) | (traits["chars"] / n > 15)),
    ]
    good = [
        np.zeros(len(n), dtype=bool),
        np.zeros(len(n), dtype=bool),
        enough & (repeats < 0.05),
        np.zeros(len(n), dtype=bool),
        enough & (capitals > 0.002) & (capitals < 0.1),
        np.zeros(len(n), dtype=bool),
        enough & (stops > 0.02) & (stops < 0.3) & (symbols < 0.02) & (marks < 0.1),
        np.zeros(len(n), dtype=bool),
    ]
    out = np.full((len(n), len(bad)), NONE, dtype=np.int8)
    for k, (b, g) in enumerate(zip(bad, good, strict=True)):
        if k in NEED_LENGTH:
            out[~enough, k] = SKIP
        out[g, k] = GOOD
        out[b, k] = BAD
    return out


@dataclass
class Labellers:
    """Estimated share of good documents, and of outcomes by labeller, truth and outcome."""

    prior: float
    table: np.ndarray

    def chance(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of good for rows of votes. A labeller that can't tell says nothing, so
        that short texts are not held against themselves."""
        worth = np.zeros((len(self.table), 4))
        worth[:, :SKIP] = np.log(self.table[:, GOOD] / self.table[:, BAD])
        odds = np.log(self.prior / (1 - self.prior)) + worth[
            np.arange(patterns.shape[1]), patterns
        ].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracy(self) -> np.ndarray:
        """Of a labeller's votes, the share that is right."""
        spoken = self.table[:, :, :NONE] * np.array([1 - self.prior, self.prior])[None, :, None]
        return (spoken[:, BAD, BAD] + spoken[:, GOOD, GOOD]) / spoken.sum(axis=(1, 2))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> Labellers:
    """Expectation-maximisation from counts of rows of votes, starting at the majority; a
    tie of votes is bad, no votes at all lean to good."""
    bad, good = (patterns == BAD).sum(axis=1), (patterns == GOOD).sum(axis=1)
    chance = np.where(good > bad, 0.95, np.where(bad > 0, 0.05, 0.7))
    told = np.stack([patterns == v for v in (BAD, GOOD, NONE)], axis=2)
    labellers = Labellers(0.5, np.full((patterns.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = counts * np.stack([1 - chance, chance])
        seen = np.einsum("yp,pkv->kyv", weight, told) + 0.5  # none is impossible
        prior = (weight[GOOD].sum() + 1) / (counts.sum() + 2)
        labellers = Labellers(float(prior), seen / seen.sum(axis=2, keepdims=True))
        before, chance = chance, labellers.chance(patterns)
        if np.abs(chance - before).max(initial=0) < 1e-9:
            break
    return labellers


def fit_linear(
    begins: np.ndarray, buckets: np.ndarray, share: np.ndarray, chance: np.ndarray
) -> np.ndarray:
    """Logistic weights of the buckets and, last, the constant, by accelerated gradient
    steps with a small ridge. Features are square roots of shares."""
    weights, speed, rows = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), len(chance)
    if not rows:
        return weights
    value, owner = np.sqrt(share), np.repeat(np.arange(rows), np.diff(begins))
    # Bad and good weigh alike, however rare the bad are.
    balance = chance * (0.5 / max(chance.mean(), 1e-6)) + (1 - chance) * (
        0.5 / max(1 - chance.mean(), 1e-6)
    )
    for step in range(400):
        ahead = weights + speed * step / (step + 3)
        score = np.bincount(owner, ahead[buckets] * value, rows) + ahead[-1]
        error = balance * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - chance)
        slope = np.append(np.bincount(buckets, error[owner] * value, BUCKETS), error.sum()) / rows
        new = ahead - 2.0 * (slope + 1e-5 * ahead)
        speed, weights = new - weights, new
    return weights


def linear_chance(
    weights: np.ndarray, begins: np.ndarray, buckets: np.ndarray, share: np.ndarray
) -> np.ndarray:
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    score = np.bincount(owner, weights[buckets] * np.sqrt(share), len(begins) - 1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


@dataclass
class Model:
    labellers: Labellers
    weights: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Accuracies from all of ``docs``, and a scorer from about ``sample`` of them."""
    total = docs.count()
    # Twice the standard width above is still under the bound of twice the sample.
    below = int(min(1.0, sample / max(1, total)) * (1 << 32))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            traits, begins, buckets, share = profile(batch.column("text"))
            chosen = np.asarray(batch.column("draw")) < below
            mine = np.repeat(chosen, np.diff(begins))
            at = np.concatenate([[0], np.cumsum(np.where(chosen, np.diff(begins), 0))])
            rows = votes(traits)
            offsets = pa.array(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["".join(map(str, r)) for r in rows.tolist()], pa.string()),
                    pa.array(chosen & (traits["words"] > 0)),
                    pa.ListArray.from_arrays(offsets, pa.array(buckets[mine].astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(share[mine])),
                ],
                ["votes", "chosen", "buckets", "share"],
            )

    text = F.col("text").cast("string").alias("text")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)).alias("draw")
    seen = docs.select(text, "doc_id").select("text", draw).mapInArrow(
        look, "votes string, chosen boolean, buckets array<int>, share array<double>"
    )
    seen = stage(seen, "votes")
    counted = seen.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    if not counted:
        return Model(Labellers(0.5, np.full((8, 2, 3), 1 / 3)), np.zeros(BUCKETS + 1))
    patterns = np.array([[int(c) for c in r["votes"]] for r in counted], np.int64)
    labellers = estimate(patterns, np.array([r["n"] for r in counted], np.float64))
    rows = seen.filter("chosen").orderBy("votes", F.xxhash64("buckets", "share"))
    rows = rows.limit(2 * sample).collect()
    begins = np.concatenate([[0], np.cumsum([len(r["buckets"]) for r in rows])]).astype(np.int64)
    flat = lambda name, kind: np.array([x for r in rows for x in r[name]], kind)
    own = np.array([[int(c) for c in r["votes"]] for r in rows], np.int64)
    chance = labellers.chance(own) if len(rows) else np.empty(0)
    return Model(labellers, fit_linear(begins, flat("buckets", np.int64), flat("share", float), chance))


def _scored(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Chance of good by votes and by the scorer; none for texts without words."""
    traits, begins, buckets, share = profile(texts)
    empty = traits["words"] == 0
    told = model.labellers.chance(votes(traits).astype(np.int64))
    score = linear_chance(model.weights, begins, buckets, share)
    return np.where(empty, 0.0, told), np.where(empty, 0.0, score)


def score(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, the chance of good by the labellers' votes, by
    the scorer, and whether the document is kept."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            told, good = _scored(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(told), pa.array(good), pa.array(good >= least)],
                ["doc_id", "voted", "score", "kept"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        judge, "doc_id long, voted double, score double, kept boolean"
    )


def keep_good(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose text the scorer takes for good, with all their columns."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            good = _scored(model, batch.column("text").cast(pa.string()))[1]
            yield batch.filter(pa.array(good >= least))

    return docs.mapInArrow(judge, docs.schema)


def classify(docs: DataFrame, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    return score(docs, fit(docs, sample), least)
