"""Near-duplicates by order min-hash and banded alignment.

A text's runs of ``run`` words are labelled with their occurrence, so repeats stay apart.
Each of ``sketches`` hash orders picks the ``picked`` smallest labelled runs and keeps them
in text order: equal picks in equal order mean that the texts share runs in sequence, which
follows edit similarity and not only the set of words. Brief texts pick single words instead,
and more of them, as few of their runs outlast an edit. Texts with an equal sketch meet in
a bucket. A bucket elects a leader, and the others are aligned with it, a few sketches at a
time: matches join classes at once, and who is in the leader's class does not meet it again.
In each further round more members lead, and meet those that are not in their class by then,
until the bucket is one class or all its members led. So a group of n copies costs about n
alignments, an unlike text among them meets each of them, no bucket is cut off, and the classes
are those of all matches within buckets. Pairs whose lengths or words rule out a match are not aligned.

A candidate counts if a banded alignment matches at least ``least`` of the longer text's
words in order. The band is as wide as that many words allow, so it never misses a match.
Classes are the connected components of these links; the smallest doc_id of a class stays.

Equal texts are one text from the start. Null and empty texts are equal texts and form one
class; texts with white space only are like others of the same text. A text of fewer words
than a run is one run. Repeated rows and rows without doc_id belong to their text's class;
a class without any doc_id has class_id null. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.components import components
from tillcast.llm.substring import with_key
from tillcast.llm.words import grams, hashes, mixed, slices, split
from tillcast.staging import stage, staged

#: Words of a run, sketches of a text, runs in a sketch, least share of matched words.
#: Of two texts of which 20 percent of the words differ at random places, about one pair in a
#: hundred shares no sketch; the tests measure it for 5 to 50 words.
RUN, SKETCHES, PICKED, LEAST = 3, 40, 2, 0.8
#: Bits of a text's bag of words; leaders of a bucket in each round, for one in the round before.
BAG, MORE = 1024, 64
#: Hash orders at which the waves begin.
WAVES = (0, 3)
#: Bits of the bags of members that are still apart after the waves, members in a block, and
#: blocks of a bucket whose members may lead in one round.
WIDE, BLOCK_ROWS, HEADS = 8192, 1024, 16
#: Texts of fewer words than ``BRIEF`` have sketches of ``FEW`` single words.
BRIEF, FEW = 16, 4
#: Numbers in the table of hash orders that is filled at once.
BLOCK = 1 << 20


def labelled(words: np.ndarray, run: int) -> np.ndarray:
    """Hashes of a text's runs; a repeated run differs by its occurrence."""
    if not len(words):
        return words
    found = grams(words, min(run, len(words)))
    order = np.argsort(found, kind="stable")
    sorted_ = found[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    if new.all():
        return found
    starts = np.flatnonzero(new)
    nth = np.arange(len(found)) - np.repeat(starts, np.diff(np.append(starts, len(found))))
    label = np.empty(len(found), dtype=np.uint64)
    label[order] = nth.astype(np.uint64)
    return np.where(label > 0, mixed(found ^ mixed(label)), found)


def order_sketches(runs: np.ndarray, sketches: int, picked: int) -> np.ndarray:
    """One number per hash order: the smallest runs by it, in text order."""
    multipliers = mixed(np.arange(1, sketches + 1, dtype=np.uint64)) | np.uint64(1)
    take = min(picked, len(runs))
    block = max(1, BLOCK // len(runs))
    parts = []
    for a in range(0, sketches, block):
        orders = runs[None, :] * multipliers[a : a + block, None]
        if take < len(runs):
            places = np.argpartition(orders, take - 1, axis=1)[:, :take]
        else:
            places = np.broadcast_to(np.arange(take), (len(orders), take))
        parts.append(runs[np.sort(places, axis=1)])
    chosen = np.concatenate(parts)
    out = multipliers.copy()
    for column in chosen.T:
        out = mixed(out ^ column)
    return out


def text_sketches(words: np.ndarray, run: int, sketches: int, picked: int) -> np.ndarray:
    """Sketches of a text: of runs, or of single words if it is brief.

    Few runs of a brief text survive an edit. Texts that may match a brief one have both kinds.
    """
    if not len(words):
        return words
    kinds = []
    if LEAST * len(words) < BRIEF:
        kinds.append(order_sketches(labelled(words, 1), sketches, FEW))
    if len(words) >= BRIEF:
        kinds.append(order_sketches(labelled(words, run), sketches, picked))
    return np.concatenate(kinds)


def bag_bits(words: np.ndarray, size: int = BAG) -> np.ndarray:
    """``size`` bits as 64-bit numbers, set where a word or a repeat of it falls."""
    bits = np.zeros(size, dtype=np.uint8)
    bits[(mixed(labelled(words, 1)) % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def sketched(docs: DataFrame, run: int, sketches: int, picked: int) -> DataFrame:
    """doc_id, the text's key, its words, sketches and bag; a row for each of ``docs``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, begins = split(batch.column("text"))
            hashed = hashes(words)
            found, bags = [], []
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                found.append(text_sketches(hashed[a:b], run, sketches, picked))
                bags.append(bag_bits(hashed[a:b]))
            at = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64)
            ends = np.arange(len(bags) + 1, dtype=np.int32) * (BAG // 64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "k1", "k2")),
                    pa.array(np.diff(begins)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bags))),
                ],
                ["doc_id", "k1", "k2", "n_words", "sketch", "bag"],
            )

    rows = with_key(docs.select(F.col("doc_id").cast("long"), "text"))
    return rows.mapInArrow(
        sketch,
        "doc_id long, k1 long, k2 long, n_words long, sketch array<long>, bag array<long>",
    )


def matched_words(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Words matched in order by the best alignment, or 0 if fewer than ``least``.

    Rows of the alignment are bits of an integer that slides along the band.
    """
    n, m = len(a), len(b)
    short = min(n, m)
    if short < least:
        return 0
    differ = a[:short] != b[:short]
    head = int(differ.argmax()) if differ.any() else short
    rest = short - head
    differ = a[n - rest :][::-1] != b[m - rest :][::-1]
    tail = int(differ.argmax()) if differ.any() else rest
    a, b = a[head : n - tail], b[head : m - tail]
    need = least - head - tail
    if need <= 0 and not (len(a) and len(b)):
        return head + tail
    # No alignment matches more than the words that both have.
    left, in_a = np.unique(a, return_counts=True)
    right, in_b = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    if int(np.minimum(in_a[i], in_b[j]).sum()) < need:
        return 0
    band = len(a) + len(b) - 2 * max(need, 0)
    places: dict[int, list[int]] = {}
    for place, word in enumerate(a.tolist()):
        places.setdefault(word, []).append(place)
    masks: dict[int, int] = {}
    width = 2 * band + 1
    full = (1 << width) - 1
    low, open_, matched = -band, full, 0
    for row, word in enumerate(b.tolist()):
        found = places.get(word)
        if found is None:
            continue
        step = row - band - low
        if step:
            gone = open_ & ((1 << step) - 1)
            matched += step - gone.bit_count() if step <= width else width - open_.bit_count()
            open_ = (open_ >> step) | (full ^ (full >> step)) if step <= width else full
            low += step
        if len(found) <= 6:
            bits = 0
            for place in found:
                if 0 <= place - low < width:
                    bits |= 1 << (place - low)
        else:
            whole = masks.get(word)
            if whole is None:
                text = bytearray((len(a) >> 3) + 1)
                for place in found:
                    text[place >> 3] |= 1 << (place & 7)
                whole = masks[word] = int.from_bytes(text, "little")
            bits = (whole >> low if low >= 0 else whole << -low) & full
        here = open_ & bits
        open_ = ((open_ + here) | (open_ - here)) & full
    matched += width - open_.bit_count() + head + tail
    return matched if matched >= least else 0


def aligned(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (nodes a and b) whose texts align, and the share matched."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, np.empty(0, np.uint64)
        for batch in batches:
            take, share = [], []
            one, two = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            for row, (x, y) in enumerate(zip(one, two, strict=True)):
                if x != last:
                    last, first = x, hashes(split(pa.array([x]))[0])
                second = hashes(split(pa.array([y]))[0])
                longer = max(len(first), len(second))
                found = matched_words(first, second, int(np.ceil(least * longer - 1e-9)))
                if found:
                    take.append(row)
                    share.append(found / longer)
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("a").take(rows),
                    batch.column("b").take(rows),
                    pa.array(share, pa.float64()),
                ],
                ["a", "b", "share"],
            )

    named = lambda side: texts.select(
        F.struct("k1", "k2").alias(side), F.col("text").alias(f"text_{side}")
    )
    node = "struct<k1:long,k2:long>"
    return (
        pairs.join(named("b"), "b")
        .join(named("a"), "a")
        .mapInArrow(align, f"a {node}, b {node}, share double")
    )


def _alike(n: str, n_a: str, least: float) -> Column:
    """Whether two texts' numbers of words allow a match of ``least`` of the longer one's."""
    return F.least(n, n_a) >= least * F.greatest(n, n_a) - 1e-9


def _bags_alike(least: float) -> Column:
    """False only for texts that can't match, as too many words of one fall on bits of its bag
    that the other has not; columns n, bag, n_a and bag_a."""
    need = least * F.greatest("n", "n_a") - 1e-9
    bag, bag_a = F.col("bag"), F.col("bag_a")
    lacks = lambda x, y: sum(
        (F.bit_count(x[i].bitwiseAND(F.bitwise_not(y[i]))) for i in range(BAG // 64)), F.lit(0)
    )
    return (F.col("n") - lacks(bag, bag_a) >= need) & (F.col("n_a") - lacks(bag_a, bag) >= need)


def _bagged(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` whose bags allow a match."""
    one = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"), F.col("n").alias("n_a"))
    two = bags.select(F.col("node").alias("b"), "bag", "n")
    return pairs.join(two, "b").join(one, "a").filter(_bags_alike(least)).select("a", "b")


def _rooted(seats: DataFrame, stars: DataFrame | None) -> DataFrame:
    """``seats`` with the root of each node's class by now."""
    if stars is None:
        return seats.withColumn("root", F.col("node"))
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return seats.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _apart(seats: DataFrame) -> DataFrame:
    """Seats of buckets that hold more than one class."""
    held = seats.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return seats.join(held.filter("low != high").select("bucket"), "bucket", "left_semi")


def _merged(stars: DataFrame | None, links: DataFrame) -> DataFrame:
    """Each linked node but the roots, and the root of its class, after ``links`` joined some
    classes."""
    known = links if stars is None else stars.unionByName(links)
    return stage(
        components(known)
        .filter("node != root")
        .select(F.col("node").alias("a"), F.col("root").alias("b")),
        "stars",
    )


def _share() -> Column:
    """Where a member stands in its bucket, as its hash has it, from 0 to 1."""
    return F.col("turn").cast("double") / 2.0**64 + 0.5


def _wide_bags(texts: DataFrame) -> DataFrame:
    """node and a bag of ``WIDE`` bits for each text."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, begins = split(batch.column("text"))
            hashed = hashes(words)
            bags = [
                bag_bits(hashed[a:b], WIDE).tobytes()
                for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)
            ]
            columns = [batch.column("k1"), batch.column("k2"), pa.array(bags, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "wide"])

    bags = texts.select("k1", "k2", "text").mapInArrow(bag, "k1 long, k2 long, wide binary")
    return bags.select(F.struct("k1", "k2").alias("node"), "wide")


def _blocked(seats: DataFrame, led: int, leaders: int) -> DataFrame:
    """A row for each pair of blocks (i, j) in which a seat is compared: as the leader (a) of
    block i, as a member (b) of block j, or both. ``led`` members of each bucket led before.

    Only blocks that hold leaders of this round are met. As they are at most ``HEADS`` and one, a
    round copies a member, and on average a seat, about so many times, however large its bucket is.
    """
    seats = seats.withColumns(
        {"share": _share(), "blocks": F.ceil(F.col("size") / BLOCK_ROWS).cast("int")}
    )
    # All three by the same product, which keeps the order of the shares it is taken of.
    block = lambda share: F.least(
        F.floor(share * F.col("blocks")).cast("int"), F.col("blocks") - 1
    )
    seats = seats.withColumns(
        {
            "own": block(F.col("share")),
            "low": block(led / F.col("size")),
            "high": block(leaders / F.col("size")),
            "leads": ~F.col("led") & (F.col("share") < leaders / F.col("size")),
        }
    )
    place = lambda i, j, a, b: F.struct(i.alias("i"), j.alias("j"), a.alias("a"), b.alias("b"))
    own, leads, last = F.col("own"), F.col("leads"), F.least("own", "high")
    none = F.expr("CAST(array() AS ARRAY<STRUCT<i: INT, j: INT, a: BOOLEAN, b: BOOLEAN>>)")
    behind = F.transform(
        F.sequence("low", last), lambda i: place(i, own, leads & (i == own), F.lit(True))
    )
    ahead = F.transform(
        F.sequence(own + 1, F.col("blocks") - 1), lambda j: place(own, j, F.lit(True), F.lit(False))
    )
    places = F.concat(
        F.when(F.col("low") <= last, behind).otherwise(none),
        F.when(leads & (own < F.col("blocks") - 1), ahead).otherwise(none),
    )
    kept = [c for c in seats.columns if c not in ("share", "blocks", "own", "low", "high", "leads")]
    return seats.select(*kept, F.explode(places).alias("place")).select(*kept, "place.*")


def _homes(live: DataFrame) -> DataFrame:
    """node and its buckets in a fixed order, the smallest first; at most one for each sketch.

    Of two members the same one leads first wherever they meet, and soonest in the smallest
    bucket. Once it led there they have met, so they need not meet in any other.
    """
    held = F.array_sort(F.collect_list(F.struct("size", "bucket")))
    return live.groupBy("node").agg(held.getField("bucket").alias("homes"))


def _met(live: DataFrame, wide: DataFrame, led: int, leaders: int, least: float) -> DataFrame:
    """Pairs (a, b) of a bucket's next leaders and the members after them that are of another
    class and can match by lengths and wide bags.

    A bucket's members are cut into blocks by their hash. A pair of blocks is a group of
    bounded size, compared bit by bit in one place, and only pairs that can match leave it,
    each from the first of the buckets it shares alone.
    """
    rows = _blocked(live.join(wide, "node"), led, leaders).selectExpr(
        "bucket", "turn", "n", "node.k1", "node.k2", "root.k1 AS r1", "root.k2 AS r2", "wide",
        "homes", "i", "j", "a", "b",
    )
    group = ["bucket", "i", "j"]
    rows = rows.repartition(*group).sortWithinPartitions(*group)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            cuts = _group_starts(table, group)
            for x, y in pairwise(cuts):
                yield from _alike_pairs(table.slice(x, y - x), least)
            rest = table.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield from _alike_pairs(rest, least)

    node = "struct<k1:long,k2:long>"
    return rows.mapInArrow(compare, f"a {node}, b {node}")


def _group_starts(table: pa.Table, group: list[str]) -> list[int]:
    """Rows at which a group begins; the first one is 0."""
    new = np.zeros(table.num_rows, dtype=bool)
    for name in group:
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return [0, *np.flatnonzero(new).tolist()]


def _alike_pairs(table: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of a leader and a later member of another class that can match."""
    held = {
        c: table.column(c).to_numpy(zero_copy_only=False)
        for c in ("turn", "n", "k1", "k2", "r1", "r2", "a", "b")
    }
    bags = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint64)
    bags = bags.reshape(table.num_rows, -1)
    members = np.flatnonzero(held["b"])
    bucket, homes = table.column("bucket")[0].as_py(), table.column("homes").to_pylist()
    for one in np.flatnonzero(held["a"]).tolist():
        other = members
        behind = (held["turn"][other] > held["turn"][one]) | (
            (held["turn"][other] == held["turn"][one])
            & ((held["k1"][other] > held["k1"][one])
               | ((held["k1"][other] == held["k1"][one]) & (held["k2"][other] > held["k2"][one])))
        )
        behind &= (held["r1"][other] != held["r1"][one]) | (held["r2"][other] != held["r2"][one])
        n, n_one = held["n"][other], held["n"][one]
        need = least * np.maximum(n, n_one) - 1e-9
        behind &= np.minimum(n, n_one) >= need
        other, n, need = other[behind], n[behind], need[behind]
        if not len(other):
            continue
        mine, theirs = bags[one][None, :], bags[other]
        lacks = np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64)
        lacking = np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64)
        other = other[(n_one - lacks >= need) & (n - lacking >= need)]
        if len(other):
            own = set(homes[one])
            here = [next(x for x in homes[row] if x in own) == bucket for row in other.tolist()]
            other = other[np.array(here)]
        if len(other):
            same = np.full(len(other), one)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.StructArray.from_arrays(
                        [pa.array(held[c][rows]) for c in ("k1", "k2")], ["k1", "k2"]
                    )
                    for rows in (same, other)
                ],
                ["a", "b"],
            )


def near_links(
    sketches: DataFrame, docs: DataFrame, least: float, orders: int = SKETCHES
) -> DataFrame:
    """Links (a, b) whose classes are those of all matches within buckets.

    Sketches are taken in waves of their hash ``orders``. In each wave the members of a bucket meet its leader, the
    first by hash, unless they are in its class already; matches join classes before the next
    wave. So a large group of near copies, which shares most buckets, costs about one
    alignment a member, and not one for each sketch. After the waves, further rounds let the
    next members by hash, ``MORE`` times as many and those of ``HEADS`` blocks at most, lead and
    meet those after them that are not in their class yet. So what a round copies grows with the
    seats, and a bucket of more unlike texts takes more rounds. A bucket is done when it is one class or all its members led: two
    members are compared or in one class, and no match within a bucket is lost.
    """
    node = F.struct("k1", "k2").alias("node")
    bags = sketches.select(node, F.col("n_words").alias("n"), "bag")
    turn = F.xxhash64("node").alias("turn")
    nth = F.posexplode("sketch").alias("nth", "bucket")
    buckets = sketches.select(node, F.col("n_words").alias("n"), nth)
    # A text may have sketches of two kinds in each order.
    buckets = buckets.withColumn("nth", F.col("nth") % orders)
    first = F.min(F.struct(turn, "node")).alias("first")
    sizes = buckets.groupBy("bucket").agg(first, F.count("*").alias("size"))
    sizes = stage(sizes.filter("size > 1"), "sizes")
    led = (F.col("node") == F.col("first.node")).alias("led")
    seated = buckets.join(sizes, "bucket").select("nth", "bucket", "node", "n", turn, "size", led)
    seated = stage(seated, "seated")
    involved = seated.select("node.*").distinct()
    rows = with_key(docs.select("text"))
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    texts = stage(texts.join(involved, ["k1", "k2"], "left_semi"), "texts")

    stars: DataFrame | None = None
    tried: DataFrame | None = None
    for low, high in zip(WAVES, [*WAVES[1:], None], strict=True):
        within = F.col("nth") >= low if high is None else F.col("nth").between(low, high - 1)
        wave = _rooted(seated.filter(within), stars)
        wave = stage(wave, "wave")
        leaders = wave.filter("led").select(
            "bucket", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "root"))
        )
        met = wave.filter("NOT led").join(leaders, "bucket")
        met = met.filter((F.col("root") != F.col("root_a")) & _alike("n", "n_a", least))
        pairs = met.select(F.col("node_a").alias("a"), F.col("node").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = stage(aligned(_bagged(pairs, bags, least), texts, least).select("a", "b"), "links")
        if not found.isEmpty():
            stars = _merged(stars, found)

    # One class in a bucket of two, or both have met.
    live = _apart(stage(_rooted(seated.filter("size > 2").drop("nth"), stars), "rooted"))
    live = stage(live, "live")
    wide = _wide_bags(texts.join(live.select("node.*").distinct(), ["k1", "k2"]))
    wide = stage(wide.join(_homes(live), "node"), "wide")
    led, leaders = 0, MORE
    while not live.isEmpty():
        pairs = stage(_met(live, wide, led, leaders, least).distinct(), "pairs")
        found = stage(aligned(pairs, texts, least).select("a", "b"), "links")
        joined = not found.isEmpty()
        if joined:
            stars = _merged(stars, found)
        lead = _share() < leaders / F.col("size")
        live = live.filter(F.col("size") > leaders).withColumn("led", F.col("led") | lead)
        if live.isEmpty():
            break
        if joined:
            live = _apart(stage(_rooted(live.drop("root"), stars), "rooted"))
        live = stage(live, "live")
        led, leaders = leaders, min(leaders * MORE, leaders + HEADS * BLOCK_ROWS)
    return sketches.sparkSession.createDataFrame([], tried.schema) if stars is None else stars


def text_classes(
    docs: DataFrame,
    run: int = RUN,
    sketches: int = SKETCHES,
    picked: int = PICKED,
    least: float = LEAST,
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, k1, k2, n_words) of ``docs``, and for each different text its class:
    k1, k2, class_id, texts and rows of the class, and whether the text stays."""
    own = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "k1", "k2")
    with staged(sketched(docs, run, sketches, picked), "sketched") as full:
        rows = stage(full.drop("sketch", "bag"), "rows")
        distinct = stage(
            full.groupBy("k1", "k2").agg(
                F.first("sketch").alias("sketch"),
                F.first("bag").alias("bag"),
                F.first("n_words").alias("n_words"),
                F.min(own).alias("own"),
                F.count("*").alias("n"),
            ),
            "distinct",
        )
    stars = near_links(distinct, docs, least, sketches)
    rooted = distinct.join(
        stars.select("a.k1", "a.k2", F.col("b").alias("root")), ["k1", "k2"], "left"
    ).select("k1", "k2", "own", "n", F.coalesce("root", F.struct("k1", "k2")).alias("root"))
    rooted = stage(rooted, "rooted")
    classes = rooted.groupBy("root").agg(
        F.min("own").alias("best"), F.count("*").alias("n_texts"), F.sum("n").alias("n_rows")
    )
    classes = stage(classes, "classes")
    stays = F.struct("k1", "k2") == F.struct("best.k1", "best.k2")
    told = rooted.join(classes, "root").select(
        "k1", "k2", F.col("best.doc_id").alias("class_id"), "n_texts", "n_rows",
        stays.alias("stays"),
    )
    return rows, stage(told, "told")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its class), texts
    and rows of the class, and kept, which holds for the class's smallest doc_id."""
    rows, classes = text_classes(docs, **options)
    kept: Column = F.col("stays") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return rows.join(classes, ["k1", "k2"]).select(
        "doc_id", "class_id", "n_texts", "n_rows", kept.alias("kept")
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class, with all its columns."""
    _, classes = text_classes(docs, **options)
    names = docs.columns
    row = F.struct(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names)))
    keyed = with_key(docs.select(row.alias("row"), "doc_id", "text"))
    # Of rows of one id and text, the first by their other columns.
    others = F.to_json(F.col("row"))
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", F.md5(others), others)
    one = keyed.groupBy("k1", "k2").agg(F.min_by("row", order).alias("row"))
    staying = classes.filter("stays").select("k1", "k2")
    return one.join(staying, ["k1", "k2"], "left_semi").select(
        *(F.col(f"row.c{i}").alias(n) for i, n in enumerate(names))
    )
