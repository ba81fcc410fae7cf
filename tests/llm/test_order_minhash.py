import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.llm import order_minhash
from tillcast.llm.components import components
from tillcast.llm.order_minhash import (
    PICKED,
    RUN,
    SKETCHES,
    matched_words,
    near_duplicates,
    near_links,
    one_of_each,
    order_sketches,
    sketched,
    text_sketches,
)


def lcs(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_alignment_is_exact_over_the_least():
    rng = random.Random(1)
    for _ in range(1500):
        letters = rng.choice([2, 5, 40])
        a = [rng.randrange(letters) for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = [rng.randrange(letters)] * rng.randint(0, 2)
        best = lcs(a, b)
        least = rng.randint(0, max(len(a), len(b)))
        got = matched_words(np.array(a, np.uint64), np.array(b, np.uint64), least)
        assert got == (best if best >= least else 0), (a, b, least)


def edited(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_labels_and_order():
    labelled = order_minhash.labelled
    runs = labelled(np.array([1, 1, 1, 1, 1, 1], np.uint64), 2)
    assert len(set(runs.tolist())) == 5
    there, back = np.arange(1, 60, dtype=np.uint64), np.arange(59, 0, -1, dtype=np.uint64)
    assert not set(order_sketches(there, 9, 2)) & set(order_sketches(back, 9, 2))
    assert set(order_sketches(there, 9, 1)) == set(order_sketches(back, 9, 1))


def classes(docs):
    found = {}
    for r in near_duplicates(docs).collect():
        found.setdefault(r.class_id, []).append((r.doc_id, r.kept))
    return {k: sorted(v, key=repr) for k, v in found.items()}


def test_same_classes_as_brute_force(spark, documents):
    rng = random.Random(7)
    fresh = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    passage, texts = fresh(50), []
    for _ in range(40):
        base = fresh(rng.randint(60, 150))
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            texts.append(edited(rng, base, max(1, len(base.split()) // 50)))
    texts += [f"{passage} {fresh(60)}" for _ in range(60)]
    texts += texts[:5]
    rng.shuffle(texts)
    split = [t.split() for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            longer = max(len(split[i]), len(split[j]))
            if lcs(split[i], split[j]) >= 0.8 * longer:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    expected = {}
    for i in range(len(texts)):
        expected.setdefault(root(i), []).append((i, root(i) == i))
    expected = {k: sorted(v, key=repr) for k, v in expected.items()}
    assert classes(documents(texts)) == expected


def test_edges(spark, documents):
    rows = [(0, None), (1, ""), (2, " "), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f")]
    docs = documents(rows)
    assert classes(docs) == {
        0: [(0, True), (1, False)],
        2: [(2, True)],
        5: [(5, True), (5, True), (None, False)],
    }
    extra = docs.withColumn("k1", docs.lang).withColumn("node", docs.doc_id)
    kept = one_of_each(extra)
    assert kept.columns == extra.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 5]
    assert classes(documents([])) == {}
    assert one_of_each(documents([])).collect() == []
    assert classes(documents([(None, "x")])) == {None: [(None, True)]}


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 300), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "a int, b int")).collect() == []


def same_classes(texts, links):
    """Whether ``links`` (pairs of places) connect the texts as all matching pairs do."""
    coded, known = [], {}
    for text in texts:
        coded.append(np.array([known.setdefault(w, len(known)) for w in text.split()], np.uint64))

    def roots(pairs):
        root = list(range(len(texts)))
        for i, j in pairs:
            if root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
        return root

    every = [
        (i, j) for i in range(len(texts)) for j in range(i)
        if matched_words(coded[i], coded[j], -(-4 * max(len(coded[i]), len(coded[j])) // 5))
    ]
    expected = roots(every)
    assert 1 < len(set(expected)) < len(texts)
    return roots(links) == expected


def one_bucket(spark, documents, texts):
    """Links of texts whose only sketch is the same."""
    docs = documents(texts)
    sketches = sketched(docs, 3, 1, 2).withColumn("sketch", F.array(F.lit(1).cast("long")))
    place = {(r.k1, r.k2): r.doc_id for r in sketches.collect()}
    return [(place[tuple(r.a)], place[tuple(r.b)]) for r in near_links(sketches, docs, 0.8).collect()]


def family(rng, copies, words=50):
    """Copies of a text of which 10 to 20 percent of the words are edited, so that many match
    few of the others."""
    base = " ".join(f"b{rng.random()}" for _ in range(words))
    return [edited(rng, base, rng.randint(words // 10, words // 5)) for _ in range(copies)]


def chain(rng, steps, words=50):
    """Texts that each match the one before and not the one before that."""
    text, out = [f"v{rng.random()}" for _ in range(words)], []
    for at in range(0, 9 * steps, 9):
        out.append(" ".join(text))
        for i in range(at, at + 9):
            text[i % words] = f"n{rng.random()}"
    return out


def test_chains_and_families_in_a_bucket_are_whole(spark, documents):
    rng = random.Random(3)
    texts = [*family(rng, 300), *chain(rng, 12), *chain(rng, 30)]
    rng.shuffle(texts)
    assert same_classes(texts, one_bucket(spark, documents, texts))


def test_chains_and_families_are_whole_over_many_rounds_of_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK_ROWS", 8)
    monkeypatch.setattr(order_minhash, "HEADS", 2)
    monkeypatch.setattr(order_minhash, "MORE", 16)
    rng = random.Random(5)
    texts = [*family(rng, 40), *chain(rng, 8)]
    texts += [" ".join(f"u{rng.random()}" for _ in range(50)) for _ in range(12)]
    rng.shuffle(texts)
    assert same_classes(texts, one_bucket(spark, documents, texts))


def test_a_round_copies_seats_in_proportion_and_misses_no_pair(spark, monkeypatch):
    """However large a bucket is; it takes more rounds instead."""
    monkeypatch.setattr(order_minhash, "BLOCK_ROWS", 4)
    monkeypatch.setattr(order_minhash, "HEADS", 2)
    for size in (40, 160):
        seats = spark.range(size).select(
            F.lit(1).alias("bucket"), F.col("id").alias("node"), F.xxhash64("id").alias("turn"),
            F.lit(size).alias("size"), F.lit(False).alias("led"),
        ).localCheckpoint()
        met, led = set(), 0
        while led < size:
            leaders = led + 8
            rows = order_minhash._blocked(seats, led, leaders).collect()
            assert len(rows) <= 8 * size
            groups = {}
            for r in rows:
                groups.setdefault((r.i, r.j), []).append(r)
            for group in groups.values():
                assert len(group) < 40
                met |= {(x.node, y.node) for x in group if x.a for y in group if y.b and y.turn > x.turn}
            seats = seats.withColumn("led", F.col("led") | (order_minhash._share() < leaders / F.col("size")))
            led = leaders
        assert len(met) == size * (size - 1) // 2


def test_a_pair_leaves_one_of_the_buckets_it_shares(spark):
    rows = [(b, k, 6 + b) for b in (1, 2) for k in range(6)] + [(3, 0, 20), (3, 9, 20)]
    live = spark.createDataFrame(rows, "bucket long, k long, size long").select(
        "bucket", F.struct(F.col("k").alias("k1"), F.col("k").alias("k2")).alias("node"), "size",
        F.lit(50).cast("long").alias("n"), F.xxhash64("k").alias("turn"), F.lit(False).alias("led"),
    ).withColumn("root", F.col("node"))
    bags = live.select("node", F.lit(bytes(order_minhash.WIDE // 8)).alias("wide")).distinct()
    wide = bags.join(order_minhash._homes(live), "node")
    pairs = [
        tuple(sorted((r.a.k1, r.b.k1)))
        for r in order_minhash._met(live, wide, 0, 64, 0.8).collect()
    ]
    assert sorted(pairs) == sorted([(i, j) for j in range(6) for i in range(j)] + [(0, 9)])


def test_near_copies_in_a_bucket_led_by_an_unlike_text(spark, documents):
    rng = random.Random(4)
    texts = [" ".join(f"u{rng.random()}" for _ in range(50)) for _ in range(40)]
    texts += [edited(rng, text, 8) for text in texts[:5]]
    links = one_bucket(spark, documents, texts)
    assert sorted(tuple(sorted(pair)) for pair in links) == [(i, 40 + i) for i in range(5)]


@pytest.mark.parametrize("words", [5, 6, 7, 10, 15, 16, 19, 20, 50])
def test_recall_of_the_sketches_at_the_link_threshold(words):
    """Replaced, inserted and deleted words, as many as a link allows."""
    rng = random.Random(words)
    hits = tried = 0
    while tried < 300:
        a = [rng.getrandbits(62) for _ in range(words)]
        b = list(a)
        for _ in range(max(1, words // 5)):
            at = rng.randrange(len(b))
            b[at : at + rng.choice([0, 1, 1, 1])] = [rng.getrandbits(62)] * rng.choice([0, 1, 1])
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        if a == b or not matched_words(x, y, -(-4 * max(len(a), len(b)) // 5)):
            continue
        tried += 1
        one, two = (set(text_sketches(t, RUN, SKETCHES, PICKED).tolist()) for t in (x, y))
        hits += bool(one & two)
    assert hits / tried >= 0.93, hits / tried


def test_a_large_group_of_near_copies_costs_about_an_alignment_a_member(
    spark, documents, monkeypatch
):
    """Most members are linked in the first waves; the pairs do not grow with the sketches."""
    rng = random.Random(6)
    base = " ".join(f"b{rng.random()}" for _ in range(60))
    texts = [edited(rng, base, 2) for _ in range(300)]
    pairs = []
    plain = order_minhash.aligned

    def counted(found, *rest):
        pairs.append(found.count())
        return plain(found, *rest)

    monkeypatch.setattr(order_minhash, "aligned", counted)
    assert len(classes(documents(texts))) == 1
    assert sum(pairs) < 3 * len(texts)


def test_ties_keep_a_defined_row(spark, documents):
    docs = documents([(1, "a b c d e f", "z"), (1, "a b c d e f", "b"), (1, "a b c d e f", None)])
    for order in ("source", "lang"):
        kept = one_of_each(docs.orderBy(order)).collect()
        assert [r.source for r in kept] == ["b"]
