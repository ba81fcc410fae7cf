"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of arrays.

Texts are cut into chunks no pre-token reaches over. Pre-tokens of all chunks a task meets
for the first time lie in one ragged array of symbols. In each step every sequence merges
its pair of lowest rank at all its places at once, until no sequence has a pair left; the
symbols that survive are the tokens. Sequences of over ``SHORT`` symbols share steps by
rank instead: all places of the lowest waiting rank merge together, so that the work
follows the merges and not the length times the steps.

The library's own pre-tokenizer and its handling of special strings are kept: a special
string in a text is one token. Null and empty texts have no bytes and no tokens. Texts are
counted whole. Repeated rows and null ids give a row each; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillcast.llm.chunks import LETTER, SIGN, VISIBLE, Known, chunks, joined, visible_bytes
from tillcast.llm.words import slices

#: Symbols of a sequence that merges step by step; rank of a pair that never merges.
SHORT, NONE = 256, np.iinfo(np.int32).max
#: The last of the letters whose kind no version of Unicode changes, and signs of one byte.
LATIN, SIGNS = "ɏ", frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Merges:
    """Ranks of symbol pairs and the symbol that each merge makes."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.width = max(vocabulary.values()) + 1
        pairs = np.array([(vocabulary[a], vocabulary[b]) for a, b in merges], np.int64).reshape(-1, 2)
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        self.rank_of = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = np.append(keys[self.rank_of], np.iinfo(np.int64).max)
        self.rank_of = np.append(self.rank_of, np.int32(NONE))
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.rank_of[at], np.int32(NONE))

    def pair_ranks(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rank of each symbol with its successor; ``NONE`` at the end of a sequence."""
        ranks = np.full(len(symbols), NONE, np.int32)
        ranks[:-1] = self.ranks(symbols[:-1], symbols[1:])
        ranks[starts[1:] - 1] = NONE
        return ranks


def _apart(at: np.ndarray, follower: np.ndarray) -> np.ndarray:
    """Of hits that overlap, as in three equal symbols, every second one from the left."""
    tied = np.zeros(len(at), dtype=bool)
    tied[1:] = follower[:-1] == at[1:]
    if not tied.any():
        return at
    nth = np.arange(len(at))
    first = np.maximum.accumulate(np.where(tied, 0, nth))
    return at[(nth - first) % 2 == 0]


def surviving(
    merges: Merges, symbols: np.ndarray, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The symbols left after all merges, in order, and their number in each sequence; no
    sequence is empty."""
    lengths = np.diff(starts)
    counts = np.zeros(len(lengths), np.int64)
    long = lengths > SHORT
    ready: list[tuple[np.ndarray, np.ndarray]] = []
    if long.any():
        left, counts[long] = _by_rank(merges, *_taken(symbols, lengths, long))
        ready.append((left, np.repeat(np.flatnonzero(long), counts[long])))
        symbols, starts = _taken(symbols, lengths, ~long)
    number = np.flatnonzero(~long)
    symbols = symbols.copy()
    ranks = merges.pair_ranks(symbols, starts) if len(symbols) else symbols
    while len(symbols):
        lengths = np.diff(starts)
        lowest = np.minimum.reduceat(ranks, starts[:-1])
        done = lowest == NONE
        if done.any():
            counts[number[done]] = lengths[done]
            stays = np.repeat(~done, lengths)
            ready.append((symbols[~stays], np.repeat(number[done], lengths[done])))
            symbols, ranks = symbols[stays], ranks[stays]
            number, lengths, lowest = number[~done], lengths[~done], lowest[~done]
            starts = np.concatenate([[0], np.cumsum(lengths)])
            if not len(symbols):
                break
        at = np.flatnonzero(ranks == np.repeat(lowest, lengths))
        at = _apart(at, at + 1)
        symbols[at] = merges.made[ranks[at]]
        stays = np.ones(len(symbols), dtype=bool)
        stays[at + 1] = False
        place = np.concatenate([[0], np.cumsum(stays)])
        symbols, ranks, starts, at = symbols[stays], ranks[stays], place[starts], place[at]
        # Only pairs with a new symbol change rank. A sequence's first symbol has none before.
        ranks[at] = 0
        touched = np.flatnonzero((ranks == 0) | np.append(ranks[1:] == 0, False))
        fresh = np.full(len(touched), NONE, np.int32)
        inner = touched < len(symbols) - 1
        fresh[inner] = merges.ranks(symbols[touched[inner]], symbols[touched[inner] + 1])
        ranks[touched] = fresh
        ranks[starts[1:] - 1] = NONE
    owner = np.concatenate([n for _, n in ready]) if ready else np.empty(0, np.int64)
    left = np.concatenate([t for t, _ in ready]) if ready else symbols
    return left[np.argsort(owner, kind="stable")], counts


def _taken(
    symbols: np.ndarray, lengths: np.ndarray, chosen: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and starts of the chosen sequences."""
    return symbols[np.repeat(chosen, lengths)], np.concatenate([[0], np.cumsum(lengths[chosen])])


def _by_rank(
    merges: Merges, symbols: np.ndarray, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """:func:`surviving` for long sequences: ranks in ascending order, all places of a rank
    at once, symbols linked to their neighbours."""
    n = len(symbols)
    symbols = np.append(symbols, 0)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    ranks = np.append(merges.pair_ranks(symbols[:-1], starts), np.int32(NONE))
    alive = np.ones(n, dtype=bool)
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def wait(places: np.ndarray) -> None:
        places = places[ranks[places] != NONE]
        order = np.argsort(ranks[places], kind="stable")
        places = places[order]
        cuts = np.flatnonzero(np.diff(ranks[places])) + 1
        for part in np.split(places, cuts) if len(places) else []:
            rank = int(ranks[part[0]])
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(heap, rank)
            waiting[rank].append(part)

    wait(np.arange(n))
    ends = np.zeros(n + 1, dtype=bool)
    ends[starts[1:] - 1] = True
    while heap:
        rank = heapq.heappop(heap)
        at = np.unique(np.concatenate(waiting.pop(rank)))
        at = at[ranks[at] == rank]
        at = _apart(at, after[at])
        if not len(at):
            continue
        gone = after[at]
        symbols[at] = merges.made[rank]
        alive[gone] = False
        ranks[gone] = NONE
        ends[at] = ends[gone]
        after[at] = after[gone]
        before[after[gone]] = at
        touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
        fresh = merges.ranks(symbols[touched], symbols[np.minimum(after[touched], n)])
        ranks[touched] = np.where(ends[touched], np.int32(NONE), fresh)
        wait(touched)
    return symbols[:-1][alive], np.add.reduceat(alive.astype(np.int64), starts[:-1])


class Vocabulary:
    """A byte-level BPE vocabulary, and the token counts of chunks a worker has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        kind, before = model["type"], told["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges"))
        if kind != "BPE" or before.get("type") != "ByteLevel" or told["normalizer"] or not plain:
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        if before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("pre-tokens must follow the byte-level pattern, without a prefix space")
        added = told["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special strings must match exactly what they say")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ids: dict[str, int] = model["vocab"]
        self.merges = Merges(self.ids, pairs)
        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        signs = visible_bytes()
        self.plain = {sign: b for b, sign in signs.items()}
        self.symbol = np.array([self.ids[chr(signs[b])] for b in range(256)], np.int32)
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = set(special)
        self.pattern = re.compile("|".join(map(re.escape, special)).encode()) if special else None
        self.known: Known[int] = Known(self.count)

    def tokens(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all chunks in order, as plain text, and their number in each chunk."""
        pre: list[bytes] = []
        many = np.ones(len(found), np.int64)
        for i, chunk in enumerate(found):
            word = chunk[1:] if chunk[0] == " " else chunk
            # Letters after at most one space are one pre-token, a single sign behind is another.
            if word.isalpha() and (word.isascii() or max(word) <= LATIN):
                pre.append(chunk.encode())
            elif word[-1:] in SIGNS and word[:-1].isalpha() and max(word) <= LATIN:
                pre += (chunk[:-1].encode(), word[-1].encode())
                many[i] = 2
            else:
                parts = self.pre_tokenizer.pre_tokenize_str(chunk)
                pre.extend(part.translate(self.plain).encode("latin-1") for part, _ in parts)
                many[i] = len(parts)
        if not pre:
            return np.empty(0, np.int32), many
        signs = np.frombuffer(b"".join(pre), np.uint8)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pre), np.int64, len(pre)))])
        ids, left = surviving(self.merges, self.symbol[signs], starts)
        total = np.concatenate([[0], np.cumsum(left)])
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(many)])])

    def count(self, found: list[str]) -> list[int]:
        """Tokens of each chunk; a special string is one."""
        plain = [i for i, chunk in enumerate(found) if chunk not in self.special]
        total = np.ones(len(found), np.int64)
        total[plain] = self.tokens([found[i] for i in plain])[1]
        return total.tolist()

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        raw, starts = joined(texts)
        if not len(raw):
            return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        begins = self.begins(raw, starts)
        found, code, first = chunks(raw, starts, begins)
        each = np.array(self.known.of(found.to_pylist()), np.int64)[code]
        total = np.concatenate([[0], np.cumsum(each)])
        return np.diff(starts), np.diff(total[first])

    def begins(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bytes at which a chunk may begin: a single space before a visible character, a
        sign after an ASCII letter, a special string, and what follows it. No pre-token
        reaches over these; space before a special string stays with the text before it."""
        begins = np.zeros(len(raw) + 1, dtype=bool)
        begins[:-2] = (raw[:-1] == 32) & VISIBLE[raw[1:]]
        # The space that ends a text is not led on by the next text.
        begins[np.maximum(starts - 1, 0)] = False
        begins[1:-1] |= LETTER[raw[:-1]] & SIGN[raw[1:]]
        if self.pattern:
            spans = [match.span() for match in self.pattern.finditer(raw.tobytes())]
            # Not what only two texts together spell.
            ends = starts[np.searchsorted(starts, [a for a, _ in spans], side="right")]
            spans = [span for span, end in zip(spans, ends.tolist(), strict=True) if span[1] <= end]
            for a, b in spans:
                begins[max(a - 1, 0) : b] = False
            for span in spans:
                begins[list(span)] = True
        return begins[:-1]


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a worker; the file lies in the same place on every machine."""
    return Vocabulary(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(tokenizer_path)
        for batch in slices(batches, "text"):
            size, tokens = vocabulary.counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, COUNTS)
