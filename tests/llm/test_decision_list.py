import random
from collections import Counter

from tests.llm.brute import words
from tillcast.llm.decision_list import learn, quality_rules, statistics, verdict

LABEL = "doc_id long, quality int, toxic int"


def plain(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            repeated += line in seen
            seen.add(line)
    return (
        len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), repeated, len(covered)
    )


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", " ", "\n\n", "a", " a b ", "a\x0bb\x0cc\rd", "é€😀 x y z | <>", "\x00 \x1f"]
    for _ in range(150):
        w = [rng.choice(["the", "a", "é", "#x", "$$", "word", f"n{rng.random()}"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.3:
            w += w[: rng.randint(0, 30)]
        out.append("".join(x + rng.choice([" ", "  ", "\n", "\t", "\n\n"]) for x in w))
    return out + ["der " * 500, "a b c d e f g h " * 3]


def test_base_columns_equal_brute_force(spark, documents):
    rows = texts(1)
    got = quality_rules(documents(rows), spark.createDataFrame([], LABEL)).collect()
    expected = []
    for i, text in enumerate(rows):
        n = plain(text)
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        expected.append((i, *n, failed, None, not failed))
    assert sorted(tuple(r) for r in got) == expected


def test_learns_planted_junk_and_keeps_the_rest(spark, documents):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        mark = rng.choice(["$$$", "%%%"]) if bad else ""
        rows.append(" ".join(f"word{rng.randrange(900)}{mark}" for _ in range(60)))
        labels.append((i, int(not bad), 0))
    labels += [(3, None, 0), (None, 0, 0), (7, 1, 1), (7, 1, 0), (9999, 0, 0)]
    docs = documents(rows)
    given = spark.createDataFrame(labels, LABEL)
    rules = learn(statistics(docs), given)
    assert rules and all(c.feature == "symbols_per_word" for c in rules[0])
    got = {r.doc_id: r.kept for r in quality_rules(docs, given).collect()}
    assert got == {i: i % 5 != 0 for i in range(400)}


def test_edges(spark, documents):
    labels = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], LABEL)
    assert quality_rules(documents([]), labels).collect() == []
    docs = documents([(None, "w " * 30), (1, "w x " * 3), (1, "w x " * 3)])
    for name in ("n_words", "w", "x", "quality", "bad"):
        docs = docs.withColumn(name, docs.lang)
    got = sorted(((r.doc_id, r.n_words, r.kept) for r in quality_rules(docs, labels).collect()), key=repr)
    assert got == [(1, 6, False), (1, 6, False), (None, 30, False)]


def test_no_rule_means_no_verdict(spark, documents):
    assert statistics(documents(["a"])).select(verdict([]).alias("v")).first().v is None
