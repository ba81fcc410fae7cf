import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillcast.llm.spelling import GRAM, gram_places, near_words, picked_pivots, roots, spelling_forms

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, length=6, least=5, ratio=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(UP)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= least}
    near = defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def table(df):
    names = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.select(names).collect()))


def family(rng, letters, stem, many):
    return {stem + "".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(many)}


def corpus(seed):
    """Words with close neighbours and stems in common, their counts spread over powers."""
    rng = random.Random(seed)
    words = set()
    for stem in ("", "inter", "äußer", "zz", "ababab"):
        words |= family(rng, "abéß", stem, 60)
    rows = []
    for w in sorted(words):
        for _ in range(rng.choice([1, 5, 7, 26, 160])):
            shown = w.upper() if rng.random() < 0.1 else w
            rows.append(shown)
    rng.shuffle(rows)
    return [(i, " ".join(rows[i * 12 : i * 12 + 12])) for i in range(len(rows) // 12 + 1)]


@pytest.mark.parametrize("hot", [10_000, 4])
def test_forms_against_all_pairs(spark, documents, hot):
    rows = corpus(5)
    assert table(spelling_forms(documents(rows), hot=hot)) == sorted(plain(rows))


def test_chain_of_forms_and_ties(spark, documents):
    sizes = {"lantern": 5, "lanterns": 25, "lanternsx": 125, "lanternsxy": 625, "chimney": 50,
             "chimneyb": 250, "chimneya": 250}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(sizes.items())]
    got = {r.word: (r.form, r.root) for r in spelling_forms(documents(rows), noise=None).collect()}
    assert got["lantern"] == ("lanterns", "lanternsxy")
    assert got["chimney"] == ("chimneya", "chimneya")
    assert got["lanternsxy"] == (None, "lanternsxy")


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(70)], "word string, form string")
    assert {r.root for r in roots(forms).collect()} == {"w070"}


def test_a_stem_shared_by_all_words_is_refined(spark):
    """Keys are split before pairs are formed; the near words stay those of all pairs."""
    rng = random.Random(2)
    words = sorted({"q" + "stemstem" + "".join(rng.choices("abcd", k=5)) + "z" for _ in range(250)})
    got = near_words(spark.createDataFrame([(w,) for w in words], "word string"), hot=20)
    want = {(a, b) for a, b in itertools.permutations(words, 2) if one_edit(a, b)}
    assert {tuple(r) for r in got.collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 50)), min_size=3, max_size=8, unique_by=lambda p: p[0]))
def test_pivots_are_the_cheapest_disjoint_pair(places):
    chosen = picked_pivots(places)
    cost = dict(places)
    pairs = [(cost[a] + cost[b]) for a in cost for b in cost if a + GRAM <= b]
    assert chosen[0] + GRAM <= chosen[1]
    assert sum(cost[p] for p in chosen) == min(pairs)


def test_pivots_lie_in_the_prefix(spark):
    words = spark.createDataFrame([("aaaaaa",), ("lantern",), ("banana",)], "word string")
    for r in gram_places(words).collect():
        assert set(r.pivots) <= set(r.prefix) and len(r.prefix) >= 3


def test_edges(spark, documents):
    assert spelling_forms(documents([])).collect() == []
    assert spelling_forms(documents([None, "", " 12 "])).collect() == []
    rows = [(None, "Lantern lanterm"), (None, "Lantern lanterm")] * 5 + [(1, "x" * 30_000 + " ×÷×÷×÷×")] * 6
    docs = documents(rows).withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("id", F.lit(2))
    assert table(spelling_forms(docs)) == sorted(plain(rows))
    with pytest.raises(ValueError, match="4 letters"):
        spelling_forms(documents([]), length=3)
