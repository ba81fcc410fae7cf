"""Secret scanning: fixed patterns, and guess costs of values named as credentials.

Three base patterns are matched leftmost and without overlap in each whole text. The
method then looks at values that stand in a credential's context ("the password is ...",
"pwd: ...") and do not lie within a base span. A value that a base span only begins, as base
spans end at the first sign they do not know, is costed whole and its span stands beside the
base one. A value's guess cost is the cheapest
segmentation, found by dynamic programming, into

- words, as often guessed as they are frequent in the corpus itself,
- dates and years,
- repeats of a shorter unit,
- keyboard walks,
- brute force for everything else.

A value that costs at least ``10 ** STRONG`` guesses adds a span of kind ``guess``. Word
frequencies come from all documents; only parts of values found are looked up, by a join,
so neither the vocabulary nor the values reach the driver or a broadcast.

Null and empty texts have no spans. Repeated rows and null doc_ids keep a row each. An
empty table gives an empty result. Other columns are not read. Long values are whole: the
cost of brute force and walks grows by character, so no length is cut off.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.substring import with_key
from tillcast.llm.words import slices
from tillcast.staging import stage

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|credential)s?["']?"""
    r"""[ \t]*(?:\b(?:is|was)\b|:=|=>|[:=])[ \t]*["'`<]?([^\s"'`<>]{6,})""",
    re.IGNORECASE | re.ASCII,
)
#: Lower-case pieces of which a text has one if ASSIGN or CONTEXT can match.
NAMES = ("passw", "passp", "passc", "pwd", "secret", "token", "api", "credential")

#: Powers of ten: guesses from which a value is a secret, and the cost of joining patterns.
STRONG, JOIN_COST = 10.0, 0.5
#: Words rarer than this in the corpus are no words; lengths of words looked up.
RARE, WORD_MIN, WORD_MAX = 3, 3, 24

# The rows of a common keyboard, and signs often put for letters.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ('~!@#$%^&*()_+', 'QWERTYUIOP{}|', 'ASDFGHJKL:"', "ZXCVBNM<>?")
LEET = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}

DATES = (
    re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"),
    re.compile(r"(?:0?[1-9]|[12]\d|3[01])([-/.])(?:0?[1-9]|1[0-2])\1(?:(?:19|20)\d\d|\d\d)"),
    re.compile(r"(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d"),
)
YEAR = re.compile(r"(?:19|20)\d\d")
REPEAT = re.compile(r"(.{1,16}?)\1+")

SPAN = "struct<at:int,rank:int,stop:int>"
SCANNED = (
    f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
    f"base array<{SPAN}>, found array<struct<at:int,stop:int,value:string>>"
)


def _key_places() -> dict[str, tuple[float, int]]:
    """Place of each key; every row is shifted by half a key against the one above."""
    return {
        key: (column + row / 2, row)
        for rows in (KEY_ROWS, SHIFTED)
        for row, keys in enumerate(rows)
        for column, key in enumerate(keys)
    }


PLACES = _key_places()
KEYS = sum(map(len, KEY_ROWS))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns' matches."""
    spans = []
    low = text.lower()
    if any(name in low for name in NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def context_values(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of values in a credential's context that lie in no base span."""
    low = text.lower()
    if not any(name in low for name in NAMES):
        return []
    values = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:!?)]}")
        at, stop = m.start(1), m.start(1) + len(value)
        if len(value) >= 6 and not any(a <= at and stop <= b for a, _, b in base):
            values.append((at, stop, value))
    return values


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{at}:{stop}" for at, kind, stop in spans)


def parts_of(value: str) -> set[str]:
    """Letter runs of a value, plain and with signs read as letters: what may be a word."""
    parts = set()
    for text in {value.lower(), "".join(LEET.get(c, c) for c in value.lower())}:
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + WORD_MAX) + 1):
                if not text[j - 1].isalpha():
                    break
                if j - i >= WORD_MIN:
                    parts.add(text[i:j])
    return parts


def _alphabet(c: str) -> int:
    if c.isdigit():
        return 10
    if c.isalpha():
        return 26 if c.isascii() else 100
    return 33 if c.isascii() else 1000


def _walks(value: str) -> Iterator[tuple[int, int, float]]:
    """Longest runs of neighbouring keys: guesses are a first key and a way for each turn."""
    i = 0
    while i < len(value) - 1:
        j, turns, way = i, 0, None
        while j + 1 < len(value) and value[j] in PLACES and value[j + 1] in PLACES:
            (x, y), (u, v) = PLACES[value[j]], PLACES[value[j + 1]]
            step = (u - x, v - y)
            if abs(step[0]) > 1 or abs(step[1]) > 1 or step == (0, 0):
                break
            turns, way = turns + (step != way), step
            j += 1
        if j - i >= 2:
            length = j - i + 1
            yield i, j + 1, math.log10(KEYS * length) + turns * math.log10(6)
        i = max(i + 1, j)


def guess_cost(value: str, words: Mapping[str, float]) -> float:
    """Power of ten of the guesses for the cheapest segmentation of ``value``.

    ``words`` has the power of ten of guesses for each word that may occur.
    """
    n, low = len(value), value.lower()
    plain = "".join(LEET.get(c, c) for c in low)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + WORD_MIN, min(n, i + WORD_MAX) + 1):
            cost = words.get(low[i:j])
            if cost is None and (cost := words.get(plain[i:j])) is not None:
                cost += sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True)) * 0.3
            if cost is not None:
                capitals = sum(c.isupper() for c in value[i:j])
                # First or all letters capital is one guess more, others a choice each.
                usual = capitals in (0, j - i) or (capitals == 1 and value[i].isupper())
                ending[j].append((i, cost + (0.3 * (capitals > 0) if usual else 0.3 * capitals)))
        for pattern in DATES:
            if m := pattern.match(value, i):
                ending[m.end()].append((i, math.log10(365 * 100 * 4)))
        if m := YEAR.match(value, i):
            ending[m.end()].append((i, math.log10(200)))
        if (m := REPEAT.match(value, i)) and m.end() - i >= 3 and m.end() - i < n + (i > 0):
            ending[m.end()].append((i, guess_cost(m[1], words) + math.log10(m.end() - i)))
    if (m := REPEAT.fullmatch(value)) and len(m[1]) < n:
        ending[n].append((0, guess_cost(m[1], words) + math.log10(n / len(m[1]))))
    for i, j, cost in _walks(value):
        ending[j].append((i, cost))
    best = [0.0] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1] + math.log10(_alphabet(value[j - 1]))
        for i, cost in ending[j]:
            best[j] = min(best[j], best[i] + cost + JOIN_COST * (i > 0))
    return best[n]


def scan(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Base results and context values of each row, with long columns ``more``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = {name: [] for name in ("a", "k", "h", "sha", "base", "found")}
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                kinds = Counter(kind for _, kind, _ in base)
                for name, kind in (("a", 0), ("k", 1), ("h", 2)):
                    out[name].append(kinds[kind])
                out["sha"].append(hashlib.sha256(said(base).encode()).hexdigest())
                out["base"].append([dict(at=a, rank=k, stop=b) for a, k, b in base])
                found = context_values(text or "", base)
                out["found"].append([dict(at=a, stop=b, value=v) for a, b, v in found])
            span = pa.struct([("at", pa.int32()), ("rank", pa.int32()), ("stop", pa.int32())])
            value = pa.struct([("at", pa.int32()), ("stop", pa.int32()), ("value", pa.string())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(out[name], pa.int64()) for name in ("a", "k", "h")),
                    pa.array(out["sha"], pa.string()),
                    pa.array(out["base"], pa.list_(span)),
                    pa.array(out["found"], pa.list_(value)),
                    *(batch.column(name) for name in more),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found", *more],
            )

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
    return picked.mapInArrow(rows, SCANNED + "".join(f", {name} long" for name in more))


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each run of letters occurs in all texts, in lower case."""
    letters = re.compile(r"[^\W\d_]+")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            counts: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(letters.findall((text or "").lower()))
            kept = [(w, n) for w, n in counts.items() if WORD_MIN <= len(w) <= WORD_MAX]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w for w, _ in kept], pa.string()),
                    pa.array([n for _, n in kept], pa.int64()),
                ],
                ["word", "n"],
            )

    return (
        docs.select(F.col("text").cast("string"))
        .mapInArrow(counted, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def value_costs(values: DataFrame, counts: DataFrame) -> DataFrame:
    """``values`` (one column, ``value``, each once) with their ``cost``."""

    def split_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(v, p) for v in batch.column("value").to_pylist() for p in parts_of(v)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in pairs], pa.string()) for k in (0, 1)], ["value", "word"]
            )

    def costed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("value").to_pylist()
            words = [dict(pairs or []) for pairs in batch.column("words").to_pylist()]
            costs = [guess_cost(v, w) for v, w in zip(values, words, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("value"), pa.array(costs, pa.float64())], ["value", "cost"]
            )

    # Rare strings are no words; the commonest is guessed first.
    parts = values.mapInArrow(split_up, "value string, word string")
    total = counts.agg(F.sum("n").cast("double").alias("total"))
    known = (
        parts.join(counts.filter(F.col("n") >= RARE), "word")
        .join(F.broadcast(total))
        .groupBy("value")
        .agg(F.map_from_entries(F.collect_list(
            F.struct("word", F.log10(F.col("total") / F.col("n")).alias("power"))
        )).alias("words"))
    )
    return values.join(known, "value", "left").mapInArrow(costed, "value string, cost double")


def _text_rows(docs: DataFrame) -> DataFrame:
    """What :func:`scan` says of each row, written down with a number for the row."""
    return stage(scan(docs).withColumn("uid", F.monotonically_increasing_id()), "scanned")


def _guessed(scanned: DataFrame, docs: DataFrame, strong: float) -> DataFrame:
    """uid, greatest cost and added spans of rows with values in a credential's context."""
    found = scanned.select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    # Written once: both the total and the look-up read it.
    counts = stage(word_counts(docs), "words")
    costs = value_costs(found.select("value").distinct(), counts)
    span = F.struct("at", F.lit(3).alias("rank"), "stop")
    return (
        found.join(costs, "value")
        .groupBy("uid")
        .agg(
            F.max("cost").alias("max_cost"),
            F.collect_list(F.when(F.col("cost") >= strong, span)).alias("guessed"),
        )
    )


def find_secrets(docs: DataFrame, strong: float = STRONG) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts and digest of base spans, all spans
    as ``kind:start:end`` by start, how many the method added, and the greatest power of
    ten of guesses among values in a credential's context (null without any)."""
    scanned = _text_rows(docs)
    added = _guessed(scanned, docs, strong)
    none = F.array().cast(f"array<{SPAN}>")
    guessed = F.coalesce("guessed", none)
    ordered = F.sort_array(F.concat("base", guessed))
    kinds = F.array(*map(F.lit, KINDS))
    text = F.transform(
        ordered, lambda s: F.concat_ws(":", kinds[s["rank"]], s["at"], s["stop"])
    )
    return scanned.join(added, "uid", "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.concat_ws(",", text).alias("spans"),
        F.size(guessed).cast("long").alias("n_guess"),
        F.round("max_cost", 6).alias("guess_power"),
    )


def mask_secrets(docs: DataFrame, strong: float = STRONG, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with all spans of secrets in ``text`` replaced by ``mark``, and ``n_chars``,
    if there is one, set to the new length of those texts. Overlapping spans become one."""
    # One row for each different text, so that the spans can be joined by content.
    texts = with_key(docs.select("text"))
    scanned = stage(
        scan(texts.select(F.lit(None).alias("doc_id"), "text", "k1", "k2"), ("k1", "k2"))
        .filter((F.size("base") > 0) | (F.size("found") > 0))
        .dropDuplicates(["k1", "k2"])
        .withColumn("uid", F.monotonically_increasing_id()),
        "scanned",
    )
    none = F.array().cast(f"array<{SPAN}>")
    spans = scanned.join(_guessed(scanned, docs, strong), "uid", "left").select(
        "k1", "k2", F.sort_array(F.concat("base", F.coalesce("guessed", none))).alias("spans")
    )
    spans = stage(spans.filter(F.size("spans") > 0), "spans")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(
                batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True
            ):
                parts, end = [], 0
                for s in found:
                    if s["at"] >= end:
                        parts += [text[end : s["at"]], mark]
                    end = max(end, s["stop"])
                out.append("".join(parts) + text[end:])
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(out, pa.string())],
                ["k1", "k2", "masked"],
            )

    # Only texts with spans are rewritten and carried to their rows.
    rewritten = stage(
        texts.join(spans, ["k1", "k2"])
        .groupBy("k1", "k2")
        .agg(F.first("text").alias("text"), F.first("spans").alias("spans"))
        .mapInArrow(mask, "k1 long, k2 long, masked string"),
        "rewritten",
    )
    names = docs.columns
    row = F.struct(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names))).alias("row")
    joined = with_key(docs.select(row, "text")).join(rewritten, ["k1", "k2"], "left")
    masked = F.col("masked")
    new = {"text": masked, "n_chars": F.length(masked).cast("long")}
    kept = []
    for i, (name, kind) in enumerate(docs.dtypes):
        own = F.col(f"row.c{i}")
        value = F.when(masked.isNull(), own).otherwise(new[name].cast(kind)) if name in new else own
        kept.append(value.alias(name))
    return joined.select(*kept)
