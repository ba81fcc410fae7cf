"""Texts cut into chunks that a tokenizer treats alone, each different chunk looked at once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Generic, TypeVar

import numpy as np
import pyarrow as pa

Value = TypeVar("Value")


def bytes_in(*spans: tuple[int, int]) -> np.ndarray:
    """For each byte, whether it lies in one of the closed spans."""
    table = np.zeros(256, dtype=bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


LETTER = bytes_in((65, 90), (97, 122))
SIGN = bytes_in((33, 47), (58, 64), (91, 96), (123, 126))
#: Bytes that surely begin a character other than white space, and their followers.
VISIBLE = bytes_in((33, 0xC1), (0xC3, 0xE0), (0xE4, 255))


def visible_bytes() -> dict[int, int]:
    """Byte-level vocabularies write a byte without a printable sign as 256, 257, ..."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: b if b in printable else 256 + hidden.index(b) for b in range(256)}


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts in a row, and where each text begins (rows + 1). Null is empty."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.string())])
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)
    return raw, (at - at[0]).astype(np.int64)


def chunks(
    raw: np.ndarray, starts: np.ndarray, begins: np.ndarray
) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Different chunks; the chunk at each place in order; each text's first place (rows + 1).

    ``begins`` marks the bytes at which a chunk begins besides the beginnings of texts.
    """
    begins = begins.copy()
    begins[starts[starts < len(raw)]] = True
    places = np.flatnonzero(begins)
    ends = np.append(places, len(raw)).astype(np.int32)
    coded = pa.StringArray.from_buffers(
        len(places), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())
    ).dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), np.searchsorted(places, starts)


class Known(Generic[Value]):
    """Values of chunks a worker has met, in two generations.

    When the young generation is full it replaces the old one: frequent chunks stay and
    memory is bounded, whatever the vocabulary. Chunks of over ``WIDE`` characters are
    worked out and not kept.
    """

    WIDE = 200

    def __init__(self, work: Callable[[list[str]], list[Value]], limit: int = 200_000):
        self.work = work
        self.limit = limit
        self.young: dict[str, Value] = {}
        self.old: dict[str, Value] = {}

    def of(self, wanted: list[str]) -> list[Value]:
        """The value of each chunk; unknown ones are worked out together."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        young.update({c: old[c] for c in wanted if c not in young and c in old})
        new = [c for c in wanted if c not in young]
        found = dict(zip(new, self.work(new), strict=True)) if new else {}
        young.update({c: v for c, v in found.items() if len(c) <= self.WIDE})
        return [found[c] if c in found else young[c] for c in wanted]
