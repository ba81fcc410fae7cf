"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Documents become token ids with an end id, longer ones are cut, and the pieces go to
partitions of bounded size by a hash of their own number, so that copies of one document
spread. Each partition packs by best-fit decreasing and compares its bins with the bound
of dual-feasible functions. Where the two are equal the partition's count is certified:
no other packing of these pieces has fewer bins. What a partition can't mend alone is the
room in its loosely filled bins, its gap. Loose bins of all partitions give up their
pieces; these are dealt to fewer partitions and packed again, round after round, until a
partition stands alone or nothing is loose.

Null text is empty and becomes one piece with the end id only. Repeated rows and null
doc_ids are pieces of their own. An empty table gives an empty result. Other columns of
the documents are not read.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillcast.llm.words import slices
from tillcast.staging import stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", uid long, sequence_id long, offset long, fill long, certified boolean"
#: Different chunks whose ids a worker keeps in each of two generations.
CACHE = 200_000
#: Pieces in a partition, rounds of exchange, and the fill below which a bin is loose.
PARTITION_PIECES, ROUNDS, TIGHT = 20_000, 6, 0.995


class Encoder:
    """A tokenizer and the ids of chunks it has seen; one for each worker and file.

    The chunks are kept in two generations. When the young one is full it replaces the
    old one, so frequent chunks stay and memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, chunks: list[str]) -> list[bytes]:
        """Little-endian ids of each chunk."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        young, old, hard = self.young, self.old, []
        for chunk in chunks:
            if chunk not in young:
                if chunk in old:
                    young[chunk] = old[chunk]
                elif (chunk[1:] if chunk[0] == " " else chunk).isalpha():
                    # Letters after at most one space are one pre-token: no pattern needed.
                    if chunk.isascii():
                        text = chunk.replace(" ", SPACE)
                    else:
                        text = chunk.encode().decode("latin-1").translate(VISIBLE)
                    ids = [token.id for token in self.tokenizer.model.tokenize(text)]
                    young[chunk] = array("I", ids).tobytes()
                else:
                    hard.append(chunk)
        coded = self.tokenizer.encode_batch_fast(hard, add_special_tokens=False)
        for chunk, encoding in zip(hard, coded, strict=True):
            young[chunk] = array("I", encoding.ids).tobytes()
        return [young[chunk] for chunk in chunks]


def _visible_bytes() -> dict[int, int]:
    """Byte-level vocabularies write a byte without a printable sign as 256, 257, ..."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(hidden)}


VISIBLE = _visible_bytes()
SPACE = chr(VISIBLE[32])


def token_ids(encoder: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and where each text's ids begin (rows + 1).

    Byte-level pre-tokens never reach over a space that precedes a visible character, nor
    from an ASCII letter into ASCII punctuation, so texts are cut there, and each different
    chunk is encoded once. Lead bytes of Unicode spaces stay inside chunks, which is always
    right, and special tokens hold no such place but after ``<|``, so a text with ``<|`` is
    encoded whole.
    """
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.string())])
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1]
    base, data = at[0], texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[base : at[-1]] if data else np.empty(0, np.uint8)
    starts = (at - base).astype(np.int64)
    if not len(raw):
        return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    before, after = raw[:-1], raw[1:]
    begins_here = np.zeros(len(raw) + 1, dtype=bool)
    begins_here[:-2] = (before == 32) & LEADS_ON[after]
    # A space at the end of one text is not led on by the next text's first character.
    begins_here[np.maximum(starts - 1, 0)] = False
    begins_here[1:-1] |= LETTER[before] & SIGN[after]
    whole = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
    for row in np.flatnonzero(whole):
        begins_here[starts[row] : starts[row + 1]] = False
    begins_here[starts] = True
    chunk_starts = np.flatnonzero(begins_here[:-1])
    ends = np.append(chunk_starts, len(raw)).astype(np.int32)
    chunks = pa.StringArray.from_buffers(
        len(chunk_starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())
    ).dictionary_encode()
    parts = encoder.ids(chunks.dictionary.to_pylist())
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    begins = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(parts), np.uint32)
    code = np.asarray(chunks.indices)
    many = lengths[code]
    total = np.concatenate([[0], np.cumsum(many)])
    ids = flat[np.repeat(begins[code] - total[:-1], many) + np.arange(total[-1])]
    return ids, total[np.searchsorted(chunk_starts, starts)]


def _bytes_in(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


LETTER = _bytes_in((65, 90), (97, 122))
SIGN = _bytes_in((33, 47), (58, 64), (91, 96), (123, 126))
LEADS_ON = _bytes_in((33, 0xC1), (0xC3, 0xE0), (0xE4, 255))


@lru_cache(maxsize=2)
def load_encoder(path: str) -> Encoder:
    """The encoder of a worker; the file lies in the same place on every machine."""
    return Encoder(path)


def cut(count: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``count`` ids: all full but maybe the first."""
    first = count % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, count, capacity))]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece; every text is tokenised whole."""
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer_path)
        for batch in slices(batches, "text"):
            ids, at = token_ids(encoder, batch.column("text"))
            raw = memoryview(ids.astype("<u4").tobytes())
            rows, piece, start, length, crc = [], [], [], [], []
            for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                for k, (s, n) in enumerate(cut(b - a + 1, capacity)):
                    stop = min(a + s + n, b)
                    check = zlib.crc32(raw[4 * (a + s) : 4 * stop])
                    rows.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(end, check) if s + n > b - a else check)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())).cast(pa.int64()),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    # doc_id may be absent of type (all null); the cast keeps the schema fixed.
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        pieces, PIECES
    )


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins by dual-feasible functions: thresholds and the rounding family."""
    if not len(lengths):
        return 0
    size = np.sort(lengths.astype(np.int64))
    sums = np.concatenate([[0], np.cumsum(size)])
    best = -(-int(sums[-1]) // capacity)
    # Over capacity - t counts as a whole bin, below t as nothing.
    t = np.unique(size[size <= capacity // 2])
    if len(t):
        low = np.searchsorted(size, t, "left")
        high = np.searchsorted(size, capacity - t, "right")
        whole = (len(size) - high) * capacity + sums[high] - sums[low]
        best = max(best, int(-(-whole.max() // capacity)))
    for k in range(1, 21):
        scaled = size * (k + 1)
        exact = scaled % capacity == 0
        # k times the function's value, in units of the capacity.
        value = np.where(exact, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int(value.sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece; lengths must come in falling order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = used = 0
    for i, n in enumerate(lengths.tolist()):
        fitting = open_rooms >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            left, chosen = capacity, used
            used += 1
        bins[i], offsets[i] = chosen, capacity - left
        left -= n
        if left:
            room[left].append(chosen)
            open_rooms |= 1 << left
    return bins, offsets, used


def _packer(capacity: int, round_no: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        size = rows["length"].to_numpy(np.int64)
        bins, offsets, used = best_fit_decreasing(size, capacity)
        fill = np.bincount(bins, weights=size, minlength=used).astype(np.int64)
        # Unique without a global count: the round, the partition, the bin in it.
        rows["sequence_id"] = (np.int64(round_no) << 58) + (np.int64(key[0]) << 26) + bins
        rows["offset"] = offsets
        rows["fill"] = fill[bins]
        rows["certified"] = used == lower_bound(size, capacity)
        return rows.drop(columns="part")

    return pack


def pack_pieces(
    pieces: DataFrame,
    capacity: int,
    partition_pieces: int = PARTITION_PIECES,
    rounds: int = ROUNDS,
    tight: float = TIGHT,
) -> DataFrame:
    """``pieces`` (PIECES and a unique ``uid``) with sequence_id and offset.

    A partition holds about ``partition_pieces`` pieces at any input size. Bins at or over
    ``tight`` of the capacity stay in place when partitions exchange.
    """
    done: list[DataFrame] = []
    left, count = pieces, pieces.count()
    for round_no in range(rounds):
        parts = max(1, math.ceil(count / partition_pieces))
        dealt = left.withColumn(
            "part", F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(parts)).cast("long")
        )
        packed = stage(
            dealt.groupBy("part").applyInPandas(_packer(capacity, round_no), PACKED), "packed"
        )
        loose = F.col("fill") < int(tight * capacity)
        alone = parts == 1 or round_no == rounds - 1
        count = 0 if alone else packed.filter(loose).count()
        if not count:
            done.append(packed)
            break
        done.append(packed.filter(~loose))
        left = packed.filter(loose).drop("sequence_id", "offset", "fill", "certified")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, **options
) -> DataFrame:
    """Pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset,
    fill of the sequence, and whether its partition's bin count is certified."""
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id)
    pieces = stage(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pack_pieces(pieces, capacity, **options).drop("uid")


