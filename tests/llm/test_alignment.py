import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillcast.llm import alignment
from tillcast.llm.alignment import Rows, align_tokens, load_pair, products, token_links

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PIECES = [
    "a", "be", "the", " ", "  ", "\n", "<|endoftext|>", "<s>", "<0x41>", "é", "ß", "日本", "🎉",
    "\xa0", "　", "1", "23", ".", ",", "'s", "!!!", "\x1c", "\x00", "ก็", "___", "ﬁ", "walking",
]
TEXTS = [
    None, "", " ", "a  b ", "one▁two", "<s> <|endoftext|> </s>", "naïve café — déjà vu", "x" * 3000,
    "日本語のテキスト" * 50, "tokens walking, walked 12345 times\n\n  end", "the same words " * 40,
]


def plain(texts):
    """Rows by set operations on byte ranges of whole texts."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def piece(i):
        return bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()

    def ranges(ids, told):
        out, at = [], 0
        for i, t in zip(ids, told, strict=True):
            out.append((at, at + len(t), i))
            at += len(t)
        return out

    told = []
    for text in texts:
        a = one.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        ta, tb = [bytes(byte[c] for c in one.id_to_token(i)) for i in a], [piece(i) for i in b]
        good = text and b"".join(ta) == b"".join(tb) == f" {text}".encode()
        told.append((ranges(a, ta), ranges(b, tb)) if good else ([], []))
    counts = Counter()
    details = []
    for a, b in told:
        end_b = {stop: i for _, stop, i in b}
        links = [(i, end_b[stop]) for _, stop, i in a if stop in end_b]
        counts.update(links)
        cuts = sorted({x[1] for x in a} & set(end_b))
        groups = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            sides = [",".join(str(i) for u, v, i in side if low < v <= high) for side in (a, b)]
            groups.append("|".join(sides))
        n_overlaps = sum(max(u, x) < min(v, y) for u, v, _ in a for x, y, _ in b)
        n_shared = sum((g.split("|")[0].count(",") + 1) * (g.split("|")[1].count(",") + 1) for g in groups)
        details.append((a, b, links, groups, n_overlaps, n_shared))
    highest = Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    return [
        (
            len(a), len(b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links),
            sum(counts[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
            n_overlaps, n_shared,
        )
        for a, b, links, groups, n_overlaps, n_shared in details
    ]


def check(spark, documents, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r[0]: tuple(r)[1:] for r in align_tokens(documents(rows), A, B).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)


def test_documents_against_sets_of_ranges(spark, documents):
    check(spark, documents, TEXTS + TEXTS[6:9])
    rng = random.Random(3)
    check(spark, documents, ["".join(rng.choices(PIECES, k=rng.randint(1, 25))) for _ in range(300)])


def test_small_blocks_give_the_same(spark, documents, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 7)
    monkeypatch.setattr(alignment, "TOGETHER", 10)
    load_pair.cache_clear()
    pair = load_pair(A, B)
    chunks = pa.array([" walking", " naïve", " 日本語のテキスト", " one▁two", " " * 5 + "x"])
    small = pair.align(chunks)
    monkeypatch.undo()
    whole = pair.align(chunks)
    assert small.right.tolist() == whole.right.tolist() == [True, True, True, False, True]
    assert small.figures.tolist() == whole.figures.tolist()
    assert small.slots == whole.slots and small.groups == whole.groups


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 12), st.integers(1, 12), st.integers(1, 12))
def test_products_are_those_of_dense_matrices(seed, n, k, m):
    rng = np.random.default_rng(seed)
    left, right = rng.random((n, k)) < 0.4, rng.random((k, m)) < 0.4

    def sparse(dense):
        rows, columns = np.nonzero(dense)
        starts = np.searchsorted(rows, np.arange(len(dense) + 1))
        return Rows(starts, columns, dense.shape[1])

    found = np.zeros((n, m), int)
    for rows, columns, total in products(sparse(left), sparse(right)):
        found[rows, columns] = total
    assert (found == left.astype(int) @ right.astype(int)).all()
    turned = sparse(right).transposed()
    want = sparse(right.T)
    assert turned.starts.tolist() == want.starts.tolist()
    assert turned.columns.tolist() == want.columns.tolist()


def test_pairs_of_the_vocabularies_hold_all_links(spark, documents):
    pair = load_pair(A, B)
    rows = token_links(documents([(1, t) for t in TEXTS if t]), A, B).filter("kind = 'end'")
    keys = rows.select((F.col("a").cast("long") * len(pair.bytes_b) + F.col("b")).alias("key"))
    assert set(keys.toPandas()["key"]) <= set(pair.pairs.tolist())


@pytest.mark.parametrize("kind", ["overlap", "end", "group"])
def test_link_rows_agree_with_the_digest(spark, documents, kind):
    docs = documents([(i, t) for i, t in enumerate(TEXTS)])
    rows = token_links(docs, A, B).filter(F.col("kind") == kind)
    many = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    column = {"overlap": "n_overlaps", "end": "n_links", "group": "n_shared"}[kind]
    for r in align_tokens(docs, A, B).collect():
        assert many.get(r.doc_id, 0) == r[column]


def test_edges(spark, documents):
    docs = documents([(None, "no id"), (7, "twice"), (7, "twice")])
    docs = docs.withColumn("links", F.lit("x")).withColumn("slot", F.lit(1))
    got = align_tokens(docs, A, B).collect()
    assert sorted((r.doc_id or 0, r.n_links > 0) for r in got) == [(0, True), (7, True), (7, True)]
    # Repeated rows count as often as they are there.
    assert {r.count_sum // r.n_links for r in got if r.doc_id == 7} == {2}
    assert align_tokens(documents([]), A, B).collect() == []
    assert token_links(documents([]), A, B).collect() == []
