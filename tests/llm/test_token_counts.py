import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillcast.llm import token_counts
from tillcast.llm.token_counts import count_tokens, load_vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = [
    "a", "be", "the", " ", "  ", "\n", "\t", "<|endoftext|>", "<|endoftext", "|>", "é", "ß",
    "日本", "🎉", "\xa0", "　", "1", "23", ".", ",", "'s", "'", "!!!", "\x1c", "\x00", "\x85",
    "İ", "ก็", "-", "___", "zz",
]
HARD = [
    "", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|>", ".<|endoftext|>.", "x" * 5000,
    "ab" * 3000 + "the" * 2000, "日本語" * 1000, "qwertzuiopasdfghjklyxcvbnm" * 400, "\n" * 3000,
]


def expected(texts):
    coded = LIBRARY.encode_batch(texts, add_special_tokens=False)
    return [(len(t.encode()), len(c.ids)) for t, c in zip(texts, coded, strict=True)]


def counted(texts):
    size, tokens = load_vocabulary(PATH).counts(pa.array(texts, pa.string()))
    return list(zip(size.tolist(), tokens.tolist(), strict=True))


@pytest.mark.parametrize("short", [0, 5, 256])
def test_hard_texts_by_both_ways_of_merging(monkeypatch, short):
    monkeypatch.setattr(token_counts, "SHORT", short)
    load_vocabulary.cache_clear()
    assert counted(HARD) == expected(HARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=8))
def test_mixed_texts(texts):
    assert counted(texts) == expected(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_any_texts(texts):
    texts = [t.encode(errors="ignore").decode() for t in texts]
    assert counted(texts) == expected(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), min_size=1, max_size=25).map("".join), max_size=8))
def test_ids_of_chunks(found):
    ids, many = load_vocabulary(PATH).tokens(found)
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    want = [c.ids for c in plain.encode_batch(found, add_special_tokens=False)]
    cuts = np.cumsum(many)
    assert [part.tolist() for part in np.split(ids, cuts[:-1])][: len(found)] == want


def test_memory_of_chunks_is_bounded(monkeypatch):
    load_vocabulary.cache_clear()
    vocabulary = load_vocabulary(PATH)
    monkeypatch.setattr(vocabulary.known, "limit", 50)
    for i in range(40):
        texts = [f"word{'abcdefghij'[k % 10] * (k % 7)} {i} q{i * 31 + k}" for k in range(20)]
        assert counted(texts) == expected(texts)
        assert len(vocabulary.known.young) <= 50 + 200


def test_query_rows(spark, documents):
    rows = [*enumerate(HARD), (3, "again"), (3, "again"), (None, "no id"), (99, None)]
    clashing = documents(rows).withColumn("n_tokens", F.lit("x")).withColumn("counts", F.lit(1))
    got = count_tokens(clashing, PATH, limit=1000)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = expected([t or "" for _, t in rows])
    want = [(i, a, b, b > 1000) for (i, _), (a, b) in zip(rows, want, strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert count_tokens(documents([]), PATH).collect() == []
