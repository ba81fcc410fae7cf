import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillcast.llm.mixing import poisson_mix, source_rates


def draw(seed, doc_id):
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16) / 2**48


def count(rate, u):
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_equal_brute_force_and_reach_the_weights(spark, documents):
    rows = [(i, "x" * (1 + i % 7), "abc"[i % 3] if i % 4 else "a") for i in range(900)]
    weights = {"a": 1.0, "b": 4.0, "c": 0.0}
    held = Counter()
    for _, text, source in rows:
        held[source] += len(text)
    rate = {s: w / 5.0 * sum(held.values()) / held[s] for s, w in weights.items()}
    want = Counter()
    for i, _, source in rows:
        for copy in range(count(rate[source], draw(7, i)) if rate[source] else 0):
            want[i, copy] += 1
    got = poisson_mix(documents(rows), weights, 7).collect()
    assert Counter((r.doc_id, r.copy) for r in got) == want
    size = Counter()
    for r in got:
        size[r.source] += len(r.text)
    assert abs(size["b"] / sum(size.values()) - 0.8) < 0.05 and not size["c"]
    assert [r.doc_id for r in got] != sorted(r.doc_id for r in got)


def test_high_rates_are_sums_of_draws(spark, documents):
    docs = documents([(1, "x", "small"), (2, "y" * 5000, "large")])
    weights = {"small": 1.0, "large": 1.0}
    rates = {r.mixed_source: r.mixed_rate for r in source_rates(docs, weights).collect()}
    assert rates["small"] == 2500.5
    got = poisson_mix(docs, weights, 1).groupBy("doc_id").count().collect()
    each = rates["small"] / 4
    want = sum(count(each, draw(1, "1" if not i else f"1:{i}")) for i in range(4))
    assert {r.doc_id: r["count"] for r in got}[1] == want
    assert abs(want - 2500) < 300


def test_a_tiny_source_at_a_rate_of_a_million(spark, documents):
    docs = documents([(1, "x", "small"), (2, "y" * 2_000_000, "large")])
    mixed = poisson_mix(docs, {"small": 1.0, "large": 1.0}, 1).filter("source = 'small'")
    told = mixed.agg(F.count("*"), F.countDistinct("copy"), F.min("copy"), F.max("copy")).first()
    assert abs(told[0] - 1_000_000) < 6_000
    assert told[1] == told[0] and told[2] == 0 and told[3] == told[0] - 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_documents_without_an_id_draw_each_for_itself(spark, documents, seed):
    rows = [(None, f"text number {i:04}") for i in range(1000)]
    got = poisson_mix(documents(rows), {"s": 1.0}, seed).collect()
    assert abs(len(got) - 1000) < 130
    many = Counter(r.text for r in got)
    assert len(set(many.values())) > 2
    again = Counter(r.text for r in poisson_mix(documents(rows[::-1]), {"s": 1.0}, seed).collect())
    assert many == again


def test_edges(spark, documents):
    rows = [(1, None, None), (None, "abc", None), (2, "", "s"), (2, "", "s"), (3, "abcd", "s")]
    docs = documents(rows)
    for name in ("copy", "extra", "mixed_rate", "row", "key", "count", "deal", "block"):
        docs = docs.withColumn(name, F.lit("own"))
    mixed = poisson_mix(docs, {}, 3, epochs=3.0, default_weight=1.0)
    assert set(mixed.columns) == set(docs.columns)
    got = mixed.collect()
    assert {r.row + r.key + r["count"] for r in got} == {"ownownown"}
    assert len([r.copy for r in got if r.doc_id == 2]) % 2 == 0
    assert poisson_mix(documents([]), {"s": 1.0}, 3).collect() == []
    assert poisson_mix(docs, {}, 3).collect() == []
