import random

import pytest

from tests.llm.brute import removed
from tillcast.llm.substring import SuffixAutomaton, remove_repeated, repeated_spans


def results(docs, **options):
    return [
        (r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
        for r in remove_repeated(docs, **options).collect()
    ]


def corpus(seed: int) -> list[str]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [prose(rng.randint(30, 60)) for _ in range(5)]
    texts = []
    for _ in range(120):
        text = prose(rng.randint(0, 120))
        if rng.random() < 0.5:
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(passages)
        if rng.random() < 0.1:
            text += ["the"] * rng.randint(10, 90)
        if rng.random() < 0.1:
            text += text[-50:]
        texts.append(rng.choice([" ", "  ", "\n"]).join(text))
    return texts + texts[:3]


@pytest.mark.parametrize("shard_words", [8000, 60])
def test_same_as_brute_force_also_when_every_shard_is_cut_again(spark, documents, shard_words):
    texts = corpus(shard_words)
    expected = [(i, *r) for i, r in enumerate(removed(texts, 35))]
    assert sorted(results(documents(texts), shard_words=shard_words)) == expected
    assert sum(r[2] for r in expected) > 1000


def test_one_passage_in_many_documents(spark, documents):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(50)]
    texts = [
        " ".join([f"x{rng.random()}" for _ in range(20)] + passage + [f"y{rng.random()}"] * 20)
        for _ in range(150)
    ]
    got = results(documents(texts), shard_words=500)
    assert sorted(got) == [(i, *r) for i, r in enumerate(removed(texts, 35))]


def test_edges(spark, documents):
    long = " ".join(f"u{i}" for i in range(35))
    rows = [(None, long), (1, None), (1, ""), (2, " \n "), (3, "short"), (3, "short"), (None, long)]
    got = {(r[0], r[1], r[2]) for r in results(documents(rows))}
    assert got == {(None, 35, 35), (1, 0, 0), (2, 0, 0), (3, 1, 0)}
    assert len(results(documents(rows))) == len(rows)
    assert results(documents([])) == []


def test_clashing_columns(spark, documents):
    docs = documents(["a b", "c"])
    for name in ("k1", "k2", "n", "spans", "shard", "piece"):
        docs = docs.withColumn(name, docs.lang)
    assert sorted(r[:3] for r in results(docs)) == [(0, 2, 0), (1, 1, 0)]


def test_automaton_counts_every_factor():
    rng = random.Random(3)
    pieces = [("".join(rng.choice("ab") for _ in range(12)), rng.randint(1, 2)) for _ in range(6)]
    automaton = SuffixAutomaton()
    paths = [automaton.add(p, n) for p, n in pieces]
    longest = automaton.repeated()
    whole = lambda x: sum(
        n * sum(p.startswith(x, i) for i in range(len(p))) for p, n in pieces
    )
    for (piece, _), path in zip(pieces, paths, strict=True):
        for i, state in enumerate(path):
            best = max((m for m in range(i + 2) if m == 0 or whole(piece[i + 1 - m : i + 1]) > 1))
            assert min(i + 1, longest[state]) == best


def test_spans_join_where_windows_touch():
    assert repeated_spans([("a b c d", 1), ("x b c d", 1)], 2) == [[(1, 4)], [(1, 4)]]
