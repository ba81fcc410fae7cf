"""Quality rules: text statistics and a learned decision list over them.

Statistics of each whole text are built-in expressions. From documents with a label a list
of rules is learned by sequential covering: a rule grows by the threshold condition with
the greatest information gain until it holds no good document of the growing part, is cut
back to the prefix that does best on the pruning part, and joins the list if it is precise
there; the documents it covers are set aside and the next rule grows. Each step is one
aggregate over binned statistics of all labelled rows. The list becomes one ordered CASE
expression, which names the rule that rejects a document.

Null text has no words. A text of fewer than 20 words, or with over 30 % of its words in
repeated windows, fails in any case. A doc_id with several labels has the lowest quality;
null qualities, labels and rows without doc_id teach nothing. Without labelled rows of both
kinds the list is empty and rejects nothing. Repeated rows keep a row each. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.staging import stage

WINDOW = 8
SPACE = " \t\n\x0b\x0c\r"
#: Cut points of a statistic; conditions of a rule; rules; least share of bad documents and
#: least number of them under a rule in the pruning part.
CUTS, CONDITIONS, RULES, PRECISION, SUPPORT = 24, 4, 12, 0.97, 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though ``body`` uses it often."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, r"[\x20\x09-\x0D]+")
    )


def _covered(windows: Column) -> Column:
    """Words in windows whose hash comes again; only for texts that have such windows."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(pairs: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(pairs, j)["h"] == e["h"], F.lit(False))
        return F.filter(pairs, lambda e, j: same(e, j - 1) | same(e, j + 1))

    def total(at: Column) -> Column:
        # The first has no place before it: least() skips the null and gives the window.
        added = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), x - F.get(at, j - 1)))
        return F.aggregate(added, F.lit(0), lambda a, b: a + b)

    places = _let(ordered, repeated)
    return _let(F.sort_array(F.transform(places, lambda e: e["i"])), total)


def _repeat_words(hashed: Column) -> Column:
    windows = F.when(
        F.size(hashed) >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size(hashed) - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(hashed, i, WINDOW)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return _let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _covered(h)
        ),
    )


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of each row's whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    from_words = _let(
        _words(text),
        lambda w: _let(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeat_words(h).cast("long").alias("n_repeat_words"),
            ),
        ),
    )
    from_lines = _let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return docs.select(
        F.col("doc_id").cast("long"),
        from_words.alias("w"),
        from_lines.alias("x"),
        _count(text, r"[#*$%&|<>]+").alias("n_symbols"),
        _count(text, "[A-Z]+").alias("n_capitals"),
        _count(text, "[!?]+").alias("n_marks"),
    ).select("doc_id", "w.*", "x.*", "n_symbols", "n_capitals", "n_marks")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def features() -> dict[str, Column]:
    """What rules may ask about: shares, which do not grow or fall with a text's length."""
    return {
        "repeat_share": _share("n_repeat_words", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "capital_share": _share("n_capitals", "word_chars"),
        "marks_per_word": _share("n_marks", "n_words"),
        "mean_word_length": _share("word_chars", "n_words"),
        "words_per_line": _share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    return reduce(and_, (F.col(c.feature) > c.cut if c.above else F.col(c.feature) <= c.cut for c in rule))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained on bad documents by a condition that leaves p bad and n good."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _cell(name: str, points: list[float]) -> Column:
    """How many cut points lie below a statistic."""
    return F.size(F.filter(F.array(*map(F.lit, points)), lambda c: c < F.col(name)))


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < CONDITIONS:
        held = rows.filter("growing")
        held = held.filter(_holds(rule)) if rule else held
        # For every statistic, how many rows of each kind lie between two cut points.
        cells = F.array(*(
            F.struct(F.lit(name).alias("feature"), _cell(name, points).alias("cell"))
            for name, points in cuts.items()
        ))
        counted = (
            held.select("bad", F.explode(cells).alias("c"))
            .groupBy("c.feature", "c.cell")
            .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
            .collect()
        )
        by = {(r["feature"], r["cell"]): (r["p"], r["n"]) for r in counted}
        best: tuple[float, Condition | None, int] = (1e-9, None, 0)
        for name, points in cuts.items():
            column = [by.get((name, k), (0, 0)) for k in range(len(points) + 1)]
            p0, n0 = (sum(x[k] for x in column) for k in (0, 1))
            if not (p0 and n0):
                continue
            p = n = 0
            for k, cut in enumerate(points):
                p, n = p + column[k][0], n + column[k][1]
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    gain = _gain(a, b, p0, n0)
                    if gain > best[0]:
                        best = (gain, Condition(name, above, cut), b)
        if best[1] is None:
            break
        rule = (*rule, best[1])
        if not best[2]:
            break
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix of the rule that does best on the pruning part, with its counts there."""
    prefixes = [rule[: k + 1] for k in range(len(rule))]
    counts = rows.filter(~F.col("growing")).agg(*(
        F.count_if(_holds(x) & (F.col("bad") if bad else ~F.col("bad"))).alias(f"c{k}_{bad:d}")
        for k, x in enumerate(prefixes) for bad in (True, False)
    )).first()
    judged = [(counts[f"c{k}_1"], counts[f"c{k}_0"]) for k in range(len(prefixes))]
    worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in judged]
    k = max(range(len(prefixes)), key=lambda i: (worth[i], judged[i][0], -i))
    return prefixes[k], *judged[k]


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules for documents of quality 0, in order."""
    worst = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).dropna()
    worst = worst.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.join(worst, "doc_id").select(
        (F.col("quality") == 0).alias("bad"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("growing"),
        *(column.alias(name) for name, column in features().items()),
    )
    rows = stage(rows, "labelled")
    at = [(k + 1) / (CUTS + 1) for k in range(CUTS)]
    # Cut points among the bad as well as all, so that a rare kind of junk has its own.
    points = rows.agg(*(
        F.percentile_approx(F.when(F.col("bad"), F.col(name)) if bad else F.col(name), at, 1000)
        .alias(f"{name}_{bad:d}") for name in features() for bad in (True, False)
    )).first()
    cuts = {
        name: sorted({float(x) for bad in (0, 1) for x in points[f"{name}_{bad}"] or []})
        for name in features()
    }
    rules: list[Rule] = []
    while len(rules) < RULES:
        rule = _grow(rows, cuts)
        if not rule:
            break
        rule, p, n = _prune(rows, rule)
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(rule)
        rows = rows.filter(~_holds(rule))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does."""
    none = F.lit(None).cast("string")
    told = None
    for rule in rules:
        holds = reduce(and_, (c.column() for c in rule))
        text = F.lit(" and ".join(map(str, rule)))
        told = F.when(holds, text) if told is None else told.when(holds, text)
    return none if told is None else told.otherwise(none)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its statistics, base_failed, the rule that rejects it
    and whether it is kept."""
    stats = stage(statistics(docs), "statistics")
    rules = learn(stats, labels)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        verdict(rules).alias("rule"),
        (~failed & verdict(rules).isNull()).alias("kept"),
    )
