"""Spelling variants: words one edit apart, found by pivotal grams.

Words are runs of letters with their number of occurrences in all texts. A word's bigrams
are ordered by how few words hold them. Its gram prefix are its three rarest (and all of the
third one's kind); of these, dynamic programming picks the two disjoint ones of least
frequency together, the pivots. One edit can touch only one of two disjoint grams, so of two
words one edit apart the one whose prefix ends earlier in the order has a pivot that is in
the other's prefix. There the position is limited: with the edit behind the pivot both words
are equal up to it, with the edit before it both are equal from it on. These equal parts, up
to or from a gram, are the index keys; candidates with an equal key are verified by their
edit distance.

A key that many words share (a common stem before the pivot) is refined before any pair is
formed: the part that may hold the edit is halved, and the half without the edit joins the
key. This goes on until a key's pairs are few or its uncertain part is one letter long, so
no group of words is ever paired with itself, however many share a stem.

A variant's form is its near word of most occurrences, if that is at least ``ratio`` times
its own; following forms to the last gives the root.

Null and empty texts have no words; a null doc_id is written as nothing where the id enters
the noise hash. Repeated rows count as often as they are there. Texts and words of any
length are taken whole. An empty table gives an empty result; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.staging import stage

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One edit touches a gram of two letters at most twice over: prefix of q · 1 + 1 grams.
GRAM, PREFIX, PIVOTS = 2, 3, 2
#: Candidate pairs of a key beyond which it is refined first.
HOT = 10_000
FORMS = "word string, form string, root string, n long, n_near long, form_n long"


def words_of(docs: DataFrame, noise: int | None = 199) -> DataFrame:
    """Every occurrence of a run, lower-cased in A-Z. Where ``noise`` divides the checksum of
    ``doc_id:run`` one letter of it is deleted, by the checksum."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]+)"), F.lit(1)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    low = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    rows = rows.select("id", low.alias("word"))
    if noise is None:
        return rows.select("word")
    check = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
    rows = rows.select("word", check.alias("check"))
    at = (F.col("check") % F.length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return rows.select(F.when(F.col("check") % noise == 0, shorter).otherwise(F.col("word")).alias("word"))


def vocabulary(docs: DataFrame, length: int, least: int, noise: int | None = 199) -> DataFrame:
    """word and n of the words of ``length`` letters or more with ``least`` occurrences."""
    long = words_of(docs, noise).filter(F.length("word") >= length)
    return long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def picked_pivots(places: list[tuple[int, int]], count: int = PIVOTS) -> list[int]:
    """Positions of ``count`` disjoint grams of least total cost among (position, cost).

    The best choice of j grams up to a place either leaves that gram out, or takes it after
    the best choice of j - 1 that ends before it. Equal costs go to the earlier grams.
    """
    places = sorted(places)
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] * (len(places) + 1)]
    for _ in range(count):
        row: list[tuple[int, list[int]] | None] = [None]
        for i, (at, cost) in enumerate(places):
            free = sum(other + GRAM <= at for other, _ in places[:i])
            before = best[-1][free]
            taken = before and (before[0] + cost, [*before[1], at])
            left = row[-1]
            row.append(min(left, taken) if left and taken else left or taken)
        best.append(row)
    chosen = best[-1][-1]
    if chosen is None:
        raise ValueError("a prefix without enough disjoint grams")
    return chosen[1]


def gram_places(words: DataFrame) -> DataFrame:
    """For each word its prefix places, its pivots, and the rank of its prefix's last gram.

    Grams are pairs of the alphabet's letters, at most some thousand: their frequencies are a
    table of proven size.
    """
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    grams = words.select("word", at.alias("at")).select(
        "word", F.substring("word", F.col("at"), F.lit(GRAM)).alias("gram")
    )
    held = grams.groupBy("gram").agg(F.count("*").alias("held")).collect()
    order = sorted((r.held, r.gram) for r in held)
    rank = {gram: i for i, (_, gram) in enumerate(order)}
    cost = {gram: n for n, gram in order}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, pivots, lasts = [], [], []
            for word in batch.column("word").to_pylist():
                own = [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]
                last = sorted(rank[g] for g in own)[PREFIX - 1]
                prefix = [i for i, g in enumerate(own) if rank[g] <= last]
                prefixes.append(prefix)
                pivots.append(picked_pivots([(i, cost[own[i]]) for i in prefix]))
                lasts.append(last)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("word"),
                    pa.array(prefixes, pa.list_(pa.int32())),
                    pa.array(pivots, pa.list_(pa.int32())),
                    pa.array(lasts, pa.int32()),
                ],
                ["word", "prefix", "pivots", "last"],
            )

    return words.select("word").mapInArrow(
        places, "word string, prefix array<int>, pivots array<int>, last int"
    )


def _keyed(places: DataFrame, column: str) -> DataFrame:
    """Two rows for each gram: the word up to the gram with the rest uncertain, and the word
    from the gram on with its beginning uncertain."""
    at, size = F.col("at"), F.length("word")
    rows = places.select("word", "last", F.explode(column).alias("at"))
    behind = F.struct(
        F.xxhash64(F.lit("up to"), F.substring("word", F.lit(1), at + GRAM)).alias("key"),
        (at + GRAM).alias("low"), size.alias("high"),
    )
    before = F.struct(
        F.xxhash64(F.lit("from"), F.substring("word", at + 1, size)).alias("key"),
        F.lit(0).alias("low"), at.alias("high"),
    )
    side = F.explode(F.array(behind, before)).alias("side")
    return rows.select("word", "last", side).select("word", "last", "side.*")


def _part(low: Column, high: Column) -> Column:
    """The word's letters from ``low`` to ``high``, both counted from 0."""
    return F.substring("word", low + 1, high - low)


def _halved(rows: DataFrame, grown: Column) -> DataFrame:
    """Rows whose uncertain part is halved. ``grown`` is how much longer the index word's part
    is than the pivot word's; halves are measured on the pivot word's part."""
    low, high = F.col("low"), F.col("high")
    mine = high - low - F.when(F.col("pivot"), 0).otherwise(grown)
    half = F.floor(mine / 2).cast("int")
    tail = mine - half
    front = F.struct(
        F.xxhash64("key", grown, F.lit("tail"), _part(high - tail, high)).alias("key"),
        low.alias("low"), (high - tail).alias("high"),
    )
    back = F.struct(
        F.xxhash64("key", grown, F.lit("head"), _part(low, low + half)).alias("key"),
        (low + half).alias("low"), high.alias("high"),
    )
    side = F.explode(F.array(front, back)).alias("side")
    rows = rows.filter(mine >= 0).select("word", "last", "pivot", "grown", side)
    # An index word may be too short for one of the halves, not for both.
    return rows.select("word", "last", "pivot", "grown", "side.*").filter("low <= high")


def candidates(places: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of words that share a key, the pivot word's prefix ending no later.

    Keys of more than ``hot`` pairs are halved until they are small or hold one uncertain
    letter of the pivot's word.
    """
    pivots = _keyed(places, "pivots").withColumn("pivot", F.lit(True))
    index = _keyed(places, "prefix").withColumn("pivot", F.lit(False))
    rows = pivots.unionByName(index).withColumn("grown", F.lit(None).cast("int"))
    done: list[DataFrame] = []
    level = 0
    while True:
        rows = stage(rows.distinct(), f"keys-{level}")
        held = rows.groupBy("key").agg(
            F.count_if("pivot").alias("one"),
            F.count_if(~F.col("pivot")).alias("two"),
            F.max(F.when(F.col("pivot"), F.col("high") - F.col("low"))).alias("open"),
        )
        large = (F.col("one") * F.col("two") > hot) & (F.col("open") > 1)
        held = stage(held.filter("one > 0 AND two > 0").select("key", large.alias("large")), "held")
        live = rows.join(held, "key")
        small = live.filter(~F.col("large"))
        sides = [
            small.filter(F.col("pivot") == pivot).select(
                "key", F.col("word").alias(word), F.col("last").alias(f"last_{word}")
            )
            for pivot, word in ((True, "a"), (False, "b"))
        ]
        close = F.abs(F.length("a") - F.length("b")) <= 1
        met = sides[0].join(sides[1], "key").filter((F.col("a") != F.col("b")) & close)
        done.append(met.filter("last_a <= last_b").select("a", "b"))
        if held.filter("large").isEmpty():
            break
        rows = live.filter("large").drop("large")
        if level == 0:
            rows = rows.drop("grown").withColumn(
                "grown", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
            )
        rows = _halved(rows, F.col("grown"))
        level += 1
    pairs = done[0]
    for more in done[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (word, near) that differ by one inserted, deleted or replaced letter, both ways."""
    places = stage(gram_places(words), "places")
    one = F.levenshtein("a", "b", 1) == 1
    found = stage(candidates(places, hot).filter(one).distinct(), "near")
    back = found.select(F.col("b").alias("word"), F.col("a").alias("near"))
    return found.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(back).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root for each row (word, form): the end of the chain of forms. Each pass
    doubles the steps taken; occurrences grow along a chain, so it has an end."""
    taken = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = taken.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage(taken.join(next_, "root", "left"), "roots")
        if moved.filter("further IS NOT NULL").isEmpty():
            return taken
        taken = moved.select("word", F.coalesce("further", "root").alias("root"))


def spelling_forms(
    docs: DataFrame, length: int = 6, least: int = 5, ratio: int = 5, noise: int | None = 199,
    hot: int = HOT,
) -> DataFrame:
    """One row per word: word, its form or null, its root, n, n_near, and the form's n."""
    if length < PREFIX + 1:
        raise ValueError(f"words need {PREFIX + 1} letters or more to have a gram prefix")
    words = stage(vocabulary(docs, length, least, noise), "words")
    near = near_words(words, hot).join(
        words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near"
    )
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    told = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    told = words.join(told, "word", "left")
    has_form = F.col("best.near_n") >= ratio * F.col("n")
    told = stage(
        told.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(has_form, F.col("best.near")).alias("form"),
            F.when(has_form, F.col("best.near_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
