import math

import numpy as np
import pyarrow as pa

from tillcast.llm.weak_labels import (
    BAD,
    GOOD,
    NONE,
    SKIP,
    classify,
    estimate,
    fit,
    fit_linear,
    keep_good,
    profile,
    votes,
)

FOLDER = "/root/testdata/sf0.01"


def test_estimates_find_planted_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    rates, rows = [0.9, 0.8, 0.7, 0.95], []
    for rate in rates:
        right = rng.random(len(truth)) < rate
        vote = np.where(right == truth, GOOD, BAD)
        vote[rng.random(len(truth)) < 0.2] = NONE
        vote[rng.random(len(truth)) < 0.1] = SKIP
        rows.append(vote)
    patterns, counts = np.unique(np.array(rows).T, axis=0, return_counts=True)
    found = estimate(patterns, counts.astype(float))
    assert abs(found.prior - 0.8) < 0.03
    assert np.abs(found.accuracy() - rates).max() < 0.03
    assert abs(found.chance(np.array([[SKIP] * 4]))[0] - found.prior) < 1e-9


def test_traits():
    traits, begins, buckets, share = profile(pa.array(["A b# b# c! d.", None, "x y z x y z"]))
    assert traits["words"].tolist() == [5, 0, 6]
    assert traits["symbols"].tolist() == [2, 0, 0]
    assert traits["echoes"].tolist() == [1, 0, 0]
    assert traits["repeats"].tolist() == [0, 0, 1]
    assert begins[1] == begins[2] and len(begins) == 4
    assert votes(traits)[0, 0] == BAD


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    joined = classify(docs).join(labels, "doc_id")
    seen = {(r.quality, r.kept): r["count"] for r in joined.groupBy("quality", "kept").count().collect()}
    good, bad = (sum(n for (q, _), n in seen.items() if q == v) for v in (1, 0))
    assert seen[1, True] >= 0.99 * good
    assert seen[0, False] >= 0.95 * bad


def test_edges(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "Some words here."), (3, "Some words here."), (None, "x")])
    got = sorted(((r.doc_id, r.kept) for r in classify(docs).collect()), key=repr)
    assert got == [(1, False), (2, False), (3, True), (3, True), (None, True)]
    extra = docs.withColumn("votes", docs.lang).withColumn("draw", docs.doc_id)
    kept = keep_good(extra, fit(extra))
    assert kept.columns == extra.columns and kept.count() == 3
    empty = documents([])
    assert classify(empty).collect() == []


def plain_em(rows, rounds=60):
    """Expectation-maximisation over single rows, with the same start and added counts."""
    chance = []
    for row in rows:
        bad, good = sum(v == BAD for v in row), sum(v == GOOD for v in row)
        chance.append(0.95 if good > bad else 0.05 if bad else 0.7)
    labellers = range(len(rows[0]))
    for _ in range(rounds):
        prior = (sum(chance) + 1) / (len(rows) + 2)
        table = {}
        for k in labellers:
            for truth in (BAD, GOOD):
                held = dict.fromkeys((BAD, GOOD, NONE), 0.5)
                for row, c in zip(rows, chance, strict=True):
                    if row[k] != SKIP:
                        held[row[k]] += c if truth == GOOD else 1 - c
                whole = sum(held.values())
                table[k, truth] = {v: n / whole for v, n in held.items()}
        chance = []
        for row in rows:
            odds = math.log(prior / (1 - prior))
            for k in labellers:
                if row[k] != SKIP:
                    odds += math.log(table[k, GOOD][row[k]] / table[k, BAD][row[k]])
            chance.append(1 / (1 + math.exp(-odds)))
    return prior, chance


def test_estimates_equal_a_plain_version_over_rows():
    rng = np.random.default_rng(4)
    rows = rng.choice([BAD, GOOD, NONE, SKIP], size=(400, 5), p=[0.2, 0.5, 0.2, 0.1])
    rows[:150, :3] = rows[:150, :1]
    patterns, counts = np.unique(rows, axis=0, return_counts=True)
    found = estimate(patterns, counts.astype(float), rounds=60)
    prior, chance = plain_em(rows.tolist())
    assert abs(found.prior - prior) < 1e-6
    assert np.abs(found.chance(rows) - chance).max() < 1e-6


def test_scorer_reaches_the_optimum():
    """At the weights found, the slope of the weighted loss with its ridge is nil."""
    rng = np.random.default_rng(5)
    rows, each = 300, 6
    buckets = rng.integers(0, 40, rows * each)
    share = np.full(rows * each, 1 / each)
    begins = np.arange(rows + 1) * each
    x = np.zeros((rows, 41))
    np.add.at(x, (np.repeat(np.arange(rows), each), buckets), np.sqrt(share))
    x[:, -1] = 1
    chance = 1 / (1 + np.exp(-(x[:, :40] @ rng.normal(size=40))))
    weights = fit_linear(begins, buckets, share, chance)
    own = np.append(weights[:40], weights[-1])
    balance = chance * 0.5 / chance.mean() + (1 - chance) * 0.5 / (1 - chance.mean())
    error = balance * (1 / (1 + np.exp(-x @ own)) - chance)
    assert np.abs(x.T @ error / rows + 1e-5 * own).max() < 1e-4
