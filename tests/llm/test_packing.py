import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillcast.llm.packing import best_fit_decreasing, cut, lower_bound, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a  b\n c\xa0d  ", "x　 y  z", "it's  \n\n 12 3", "<|endoftext|> a<|endoftext|>b",
    "  lead", "naïve café, déjà-vu... (ok)!", "word " * 700, "tail\n" * 90, "\x1c \x00 ß",
]


def expected(text, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    first = len(ids) % capacity or capacity
    starts = [0, *range(first, len(ids), capacity)]
    ends = [*starts[1:], len(ids)]
    return [
        (k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
        for k, (a, b) in enumerate(zip(starts, ends, strict=True))
    ]


def check_places(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_pieces_and_places(spark, documents):
    rows = [*enumerate(TEXTS), (3, "again"), (3, "again"), (None, "no id")]
    for options in ({}, {"partition_pieces": 3}):
        got = pack_documents(documents(rows), PATH, 64, **options).collect()
        want = [(i, *p) for i, text in rows for p in expected(text, 64)]
        have = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got]
        assert sorted(have, key=repr) == sorted(want, key=repr)
        used = check_places(got, 64)
        # Partitions of three pieces can't reach the bound.
        assert used <= lower_bound(np.array([r.length for r in got]), 64) + (4 if options else 0)
    assert pack_documents(documents([]), PATH).collect() == []
    clashing = documents(["a"]).withColumn("uid", F.lit("x"))
    assert pack_documents(clashing, PATH).count() == 1


def optimum(sizes, capacity):
    """Fewest bins, by trying all placements."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= sizes[i]:
                place(i + 1, [*rooms[:k], room - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7))
def test_bound_never_exceeds_the_optimum(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets, used = best_fit_decreasing(np.array(sizes), 20)
    best = optimum(sizes, 20)
    assert lower_bound(np.array(sizes), 20) <= best <= used
    assert len(set(bins.tolist())) == used


def test_cut():
    assert cut(1, 4) == [(0, 1)]
    assert cut(4, 4) == [(0, 4)]
    assert cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
