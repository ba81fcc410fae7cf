"""Arrow helpers for tasks that read whole texts: slices of bounded size, words, hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text a task looks at together. A longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each piece."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        block = (np.cumsum(sizes.astype(np.int64)) - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and where each text's words begin (rows + 1)."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.asarray(lists.offsets, dtype=np.int64)
    kept = np.concatenate([[0], np.cumsum(real)])
    return flat.filter(pa.array(real)), kept[ends - ends[0]]


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word; each different word is hashed once."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    coded = words.dictionary_encode()
    known = coded.dictionary.cast(pa.binary()).to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
    return table[np.asarray(coded.indices)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit integers, so that their order looks random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` words in a row, at each start; short input gives none."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + n]
    return mixed(out)
