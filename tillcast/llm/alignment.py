"""Alignment of two tokenizers' tokens by products of sparse incidence matrices.

Tokenizer A is a byte-level BPE that gets a space and the text, tokenizer B a sentencepiece
model that puts the space there itself; both then tell the same bytes. For each tokenizer a
matrix in compressed rows says which token covers which byte. The row product A·Bᵀ after
Gustavson gives the overlap links with their shared bytes. Byte offsets at which tokens of
both end cut the text into groups; the product of the token-group matrices gives the
shared-group links. Links that end together are the overlap links of equal end; an id
pair's count is the number of those in the corpus.

Texts are cut before a single space between other characters, where both tokenizers always
cut, so that each different chunk of a task's slice is aligned once; a text is its chunks in order.
Of tokens that end together one's bytes end with the other's. So the two vocabularies alone
say which id pairs there can be, some hundred thousand, whatever the corpus: pair counts
are a table of proven size, and the documents are never shuffled.

Texts that are null or empty, or whose joined A or B bytes are not space and text (as with
U+2581 in the text), have no tokens: zeros and an empty digest. Strings of special tokens
are plain text. Texts are taken whole. Repeated rows and null ids give a row each and count
in the corpus as often; an empty table gives an empty result; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.chunks import VISIBLE, chunks, joined, visible_bytes
from tillcast.llm.token_counts import Vocabulary
from tillcast.llm.words import slices
from tillcast.staging import stage

COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
ALIGNED = COUNTED + ", n_best long, count_sum long, groups_sha256 string, n_overlaps long, n_shared long"
LINKS = "doc_id long, kind string, a_place long, b_place long, a int, b int, n_bytes long"
#: Products of single entries worked out at once; bytes of a slice of texts, and of chunks
#: aligned together; documents whose links are weighed together.
BLOCK, SLICE, TOGETHER, WEIGHED = 1 << 18, 1 << 20, 1 << 18, 500


@dataclass(frozen=True)
class Rows:
    """A sparse 0/1 matrix by rows: columns of row i are ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    def transposed(self) -> Rows:
        order = np.argsort(self.columns, kind="stable")
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        held = np.bincount(self.columns, minlength=self.width)
        return Rows(np.concatenate([[0], np.cumsum(held)]), row[order], len(self.starts) - 1)


def products(left: Rows, right: Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries (row, column, sum) of left·right, some whole rows at a time.

    Each entry (i, k) of the left adds row k of the right to row i of the product; equal
    columns of a row are summed.
    """
    many = np.diff(right.starts)[left.columns]
    before = np.concatenate([[0], np.cumsum(many)])[left.starts]
    row = 0
    while row < len(left.starts) - 1:
        stop = max(row + 1, int(np.searchsorted(before, before[row] + BLOCK, side="right")) - 1)
        held = slice(left.starts[row], left.starts[stop])
        each = many[held]
        begins = np.repeat(right.starts[left.columns[held]] - (np.cumsum(each) - each), each)
        column = right.columns[begins + np.arange(each.sum())]
        rows = np.repeat(np.arange(row, stop), np.diff(left.starts[row : stop + 1]))
        rows = np.repeat(rows, each)
        key = rows * right.width + column
        if len(key) > 1 and (key[1:] < key[:-1]).any():
            key = np.sort(key)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        total = np.diff(np.append(first, len(key)))
        yield key[first] // right.width, key[first] % right.width, total
        row = stop


@dataclass(frozen=True)
class Aligned:
    """Tokens of both sides over the same bytes, and what their matrices give."""

    ends_a: np.ndarray
    ends_b: np.ndarray

    @property
    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        bytes_a, bytes_b = _covered(self.ends_a), _covered(self.ends_b)
        return products(bytes_a, bytes_b.transposed())

    def end_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a, b, shared in self.overlaps:
            together = self.ends_a[a] == self.ends_b[b]
            yield a[together], b[together], shared[together]

    def group_rows(self) -> tuple[Rows, Rows]:
        """Token-group matrices of both sides; a token lies in one group."""
        cuts = np.intersect1d(self.ends_a, self.ends_b, assume_unique=True)
        return tuple(
            Rows(np.arange(len(ends) + 1), np.searchsorted(cuts, ends), len(cuts))
            for ends in (self.ends_a, self.ends_b)
        )

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        left, right = self.group_rows()
        return products(left, right.transposed())


def _covered(ends: np.ndarray) -> Rows:
    """Which bytes each token covers."""
    starts = np.concatenate([[0], ends])
    return Rows(starts, np.arange(starts[-1]), int(starts[-1]))


def _ragged(values: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Stretches ``values[starts[i]:starts[i + 1]]`` of the chosen numbers, one after the other."""
    many = np.diff(starts)[chosen]
    begins = np.repeat(starts[chosen] - (np.cumsum(many) - many), many)
    return values[begins + np.arange(len(begins))]


class Tokens:
    """The bytes of a vocabulary's tokens."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens])
        self.starts = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def told(self, ids: np.ndarray) -> np.ndarray:
        return _ragged(self.flat, self.starts, ids)


@dataclass(frozen=True)
class Chunks:
    """What is known of some chunks: whether both sides tell their bytes; tokens of A and B,
    groups, overlap and shared-group links (five columns); slots in the pairs of the links
    that end together; and the groups as text, each with a semicolon behind it."""

    right: np.ndarray
    figures: np.ndarray
    slots: list[bytes]
    groups: list[bytes]


class Pair:
    """Two tokenizers and the id pairs that can end together."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Vocabulary(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {chr(sign): b for b, sign in visible_bytes().items()}
        vocabulary = self.a.ids
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            if all(sign in byte for sign in token):
                self.bytes_a[number] = bytes(byte[sign] for sign in token)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.told_a, self.told_b = Tokens(self.bytes_a), Tokens(self.bytes_b)
        # Each id in digits and a place for what follows it.
        self.digits = Tokens(
            [b"%d " % i for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        )
        # A model may have pieces that go on after a space: then texts stay whole.
        self.cuts = not any(b" " in t.lstrip(b" ") for t in self.bytes_b)
        self.pairs = self._pairs()

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        if self.b.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        if self.b.is_control(number) or self.b.is_unknown(number):
            return b""
        return piece.replace("▁", " ").encode()

    def _pairs(self) -> np.ndarray:
        """All id pairs of which one's bytes end with the other's, as a · width + b, sorted."""
        ids_a: dict[bytes, list[int]] = {}
        ids_b: dict[bytes, list[int]] = {}
        for ids, tokens in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            for number, token in enumerate(tokens):
                if token:
                    ids.setdefault(token, []).append(number)
        width = len(self.bytes_b)
        found = []
        for mine, others, a_first in ((ids_a, ids_b, True), (ids_b, ids_a, False)):
            for token, numbers in mine.items():
                for k in range(len(token)):
                    for other in others.get(token[k:], ()):
                        for number in numbers:
                            a, b = (number, other) if a_first else (other, number)
                            found.append(a * width + b)
        return np.unique(np.array(found, np.int64))

    def encoded(self, found: pa.StringArray) -> tuple[np.ndarray, ...]:
        """Ids of A and B in all chunks, which begin with a space; their numbers in each; and
        whether both sides tell a chunk's bytes."""
        texts = found.to_pylist()
        a, many_a = self.a.tokens(texts)
        lists = self.b.encode([text[1:] for text in texts], num_threads=1)
        many_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(chain.from_iterable(lists), np.int64, int(many_b.sum()))
        raw, starts = joined(found)
        right = np.ones(len(texts), bool)
        for ids, many, tokens in ((a, many_a, self.told_a), (b, many_b, self.told_b)):
            ends = np.concatenate([[0], np.cumsum(tokens.size[ids])])
            ends = ends[np.concatenate([[0], np.cumsum(many)])]
            right &= np.diff(ends) == np.diff(starts)
            same = np.flatnonzero(right)
            wrong = _ragged(tokens.told(ids), ends, same) != _ragged(raw, starts, same)
            if wrong.any():
                right[same[np.repeat(np.arange(len(same)), np.diff(starts)[same])[wrong]]] = False
        return a, many_a, b, many_b, right

    def align(self, found: pa.StringArray) -> Chunks:
        size = np.cumsum(np.diff(joined(found)[1])) // TOGETHER
        cuts = (np.flatnonzero(np.diff(size)) + 1).tolist()
        parts = [self._align(found[x:y]) for x, y in pairwise([0, *cuts, len(found)])]
        return Chunks(
            np.concatenate([p.right for p in parts]),
            np.concatenate([p.figures for p in parts]),
            [one for p in parts for one in p.slots],
            [one for p in parts for one in p.groups],
        )

    def _align(self, found: pa.StringArray) -> Chunks:
        a, many_a, b, many_b, right = self.encoded(found)
        if not right.all():
            a, b = a[np.repeat(right, many_a)], b[np.repeat(right, many_b)]
            many_a, many_b = many_a * right, many_b * right
        both = Aligned(np.cumsum(self.told_a.size[a]), np.cumsum(self.told_b.size[b]))
        chunk_of = np.repeat(np.arange(len(found)), many_a)
        figures = np.zeros((len(found), 5), np.int64)
        figures[:, 0], figures[:, 1] = many_a, many_b
        slots = [np.empty(0, np.int64)]
        linked = np.zeros(len(found), np.int64)
        for row, column, _ in both.overlaps:
            figures[:, 3] += np.bincount(chunk_of[row], minlength=len(found))
            together = both.ends_a[row] == both.ends_b[column]
            row, column = row[together], column[together]
            linked += np.bincount(chunk_of[row], minlength=len(found))
            slots.append(np.searchsorted(self.pairs, a[row] * len(self.bytes_b) + b[column]))
        group_a, group_b = both.group_rows()
        in_b = np.bincount(group_b.columns, minlength=group_b.width)
        shared = np.concatenate([[0], np.cumsum(in_b[group_a.columns])])
        figures[:, 4] = np.diff(shared[np.concatenate([[0], np.cumsum(many_a)])])
        # Every group is ended by one token of A.
        last = np.append(group_a.columns[1:] != group_a.columns[:-1], True)[: len(a)]
        figures[:, 2] = np.bincount(chunk_of[last], minlength=len(found))
        told, ends = self._told(a, group_a.columns, b, group_b.columns)
        stops = ends[np.concatenate([[0], np.cumsum(many_a + many_b)])].tolist()
        flat = np.concatenate(slots).astype(np.int32).tobytes()
        at = (4 * np.concatenate([[0], np.cumsum(linked)])).tolist()
        return Chunks(
            right,
            figures,
            [flat[x:y] for x, y in pairwise(at)],
            [told[x:y] for x, y in pairwise(stops)],
        )

    def _told(
        self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray
    ) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;`` for each group, and where each token's text begins."""
        groups = int(group_a[-1]) + 1 if len(a) else 0
        until_a = np.cumsum(np.bincount(group_a, minlength=groups))
        in_b = np.bincount(group_b, minlength=groups)
        until_b = np.cumsum(in_b) - in_b
        place_a = np.arange(len(a)) + until_b[group_a]
        place_b = np.arange(len(b)) + until_a[group_b]
        ids = np.empty(len(a) + len(b), np.int64)
        sign = np.full(len(ids), ord(","), np.uint8)
        for own, place, group, end in ((a, place_a, group_a, "|"), (b, place_b, group_b, ";")):
            ids[place] = own
            sign[place[np.append(group[1:] != group[:-1], True)[: len(own)]]] = ord(end)
        text = self.digits.told(ids)
        ends = np.concatenate([[0], np.cumsum(self.digits.size[ids])])
        text[ends[1:] - 1] = sign
        return text.tobytes(), ends

    def begins(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A single space between other characters, the second surely visible."""
        begins = np.zeros(len(raw), dtype=bool)
        if self.cuts:
            begins[1:-1] = (raw[:-2] != 32) & (raw[1:-1] == 32) & VISIBLE[raw[2:]]
            # Not over the border of two texts; a text's first space is no cut of its own.
            begins[np.maximum(starts[1:] - 1, 0)] = False
        return begins


@lru_cache(maxsize=2)
def load_pair(path_a: str, path_b: str) -> Pair:
    """The tokenizers of a worker; the files lie in the same place on every machine."""
    return Pair(path_a, path_b)


def _with_space(texts: pa.Array) -> pa.Array:
    """Space and text; empty texts stay empty."""
    return pa.array([f" {t}" if t else "" for t in texts.to_pylist()], pa.string())


def _first_pass(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """All columns but those that need corpus counts, and the slots of the links."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load_pair(path_a, path_b)
        for batch in slices(batches, "text", SLICE):
            raw, starts = joined(_with_space(batch.column("text")))
            rows = batch.num_rows
            figures = np.zeros((rows, 5), np.int64)
            links, digest = [b""] * rows, [""] * rows
            if len(raw):
                found, code, first = chunks(raw, starts, pair.begins(raw, starts))
                known = pair.align(found)
                wrong = np.concatenate([[0], np.cumsum(~known.right[code])])
                right = (np.diff(wrong[first]) == 0) & (np.diff(first) > 0)
                for i in range(5):
                    total = np.concatenate([[0], np.cumsum(known.figures[code, i])])
                    figures[:, i] = np.where(right, np.diff(total[first]), 0)
                for row in np.flatnonzero(right).tolist():
                    own = code[first[row] : first[row + 1]].tolist()
                    links[row] = b"".join([known.slots[c] for c in own])
                    told = b"".join([known.groups[c] for c in own])
                    digest[row] = hashlib.sha256(memoryview(told)[:-1]).hexdigest()
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in links])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(links), np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(figures[:, i]) for i in range(5)),
                    pa.array(digest),
                    pa.ListArray.from_arrays(pa.array(at), flat),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_shared", "groups_sha256", "links"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        align,
        "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_shared long, "
        "groups_sha256 string, links array<int>",
    )


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: tokens, groups, links that end together, those whose pair's
    count is the highest of its B id, the sum of the counts, a digest of the groups, and the
    numbers of overlap and shared-group links."""
    spark = docs.sparkSession
    once = stage(_first_pass(docs, path_a, path_b), "aligned")
    pair = load_pair(path_a, path_b)
    # At most one row for each pair the vocabularies allow.
    held = once.select(F.explode("links").alias("slot")).groupBy("slot").count().toArrow()
    counts = np.zeros(len(pair.pairs), np.int64)
    counts[held.column("slot").to_numpy()] = held.column("count").to_numpy()
    b = pair.pairs % len(pair.bytes_b)
    highest = np.zeros(len(pair.bytes_b), np.int64)
    np.maximum.at(highest, b, counts)
    told = spark.sparkContext.broadcast((counts, (counts == highest[b]).astype(np.int64)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, best = told.value
        for batch in (b.slice(i, WEIGHED) for b in batches for i in range(0, b.num_rows, WEIGHED)):
            links = batch.column("links")
            ends = np.asarray(links.offsets, np.int64)
            slots = np.asarray(links.flatten())
            ends = ends - ends[0]
            sums = [np.diff(np.concatenate([[0], np.cumsum(t[slots])])[ends]) for t in (best, many)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")),
                    pa.array(np.diff(ends)),
                    *map(pa.array, sums),
                    *(batch.column(c) for c in ("groups_sha256", "n_overlaps", "n_shared")),
                ],
                [field.split()[0] for field in ALIGNED.split(", ")],
            )

    return once.mapInArrow(weigh, ALIGNED)


def token_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """All links of all texts: kind (``overlap``, ``end`` or ``group``), places and ids of
    both tokens, and the bytes they share (for ``group`` the groups, 1)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load_pair(path_a, path_b)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for row, text in enumerate(texts):
                if not text:
                    continue
                a, _, b, _, right = pair.encoded(pa.array([f" {text}"]))
                if not right[0]:
                    continue
                both = Aligned(np.cumsum(pair.told_a.size[a]), np.cumsum(pair.told_b.size[b]))
                kinds = (("overlap", both.overlaps), ("end", both.end_links()), ("group", both.group_links()))
                for kind, blocks in kinds:
                    for x, y, shared in blocks:
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array(np.full(len(x), row))),
                                pa.array([kind] * len(x), pa.string()),
                                pa.array(x),
                                pa.array(y),
                                pa.array(a[x].astype(np.int32)),
                                pa.array(b[y].astype(np.int32)),
                                pa.array(shared),
                            ],
                            [field.split()[0] for field in LINKS.split(", ")],
                        )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(link, LINKS)
