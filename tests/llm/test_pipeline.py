"""The corpus pipeline: each stage on what its predecessor kept, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_pipeline import ORACLE_SQL, STAGES, run
from tests.llm.conftest import DOCUMENT
from tests.llm.test_order_minhash import lcs
from tests.llm.test_packing import check_places
from tillcast.llm import queries
from tillcast.llm.weak_labels import classify
from tillcast.staging import stage

BASE = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""", re.I
)
NAMES = ["classify_quality", "drop_near_copies", "hide_secrets", "mix_sources", "pack"]


def prose(rng, n):
    words = "the of and to in is was for that with as his on be at by this had not are".split()
    words += [f"{a}{b}" for a in ("gard", "wint", "riv", "mount", "lett") for b in ("en", "er", "al", "ing")]
    text = " ".join(rng.choice(words) for _ in range(n))
    return ". ".join(s.capitalize() for s in re.findall(r"(?:\S+ ?){1,12}", text)) + "."


def corpus():
    """Prose, junk, exact and near copies, and secrets, over three sources."""
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(40, 120)) for _ in range(60)]
    for base in texts[:8]:
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        texts += [" ".join(words), base]
    texts += [f"{prose(rng, 40)} password = {rng.getrandbits(80):x}tail" for _ in range(6)]
    junk = ["#$%& |<> *** $$$ ### " * 12, "x# y$ z% " * 30]
    texts += [junk[i % 2] + str(i) * (i % 3) for i in range(12)]
    texts += [None, "", " ", prose(rng, 6_000)]
    rng.shuffle(texts)
    return [(i, t, f"src{i % 3}") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark):
    """The table after each stage, each run on what the one before wrote."""
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in corpus()], DOCUMENT)
    tables = {"documents": docs}
    for name, function in STAGES:
        docs = stage(function(spark, docs, ""), name)
        tables[name] = docs
    return tables


def held(df):
    return sorted(map(tuple, df.select("doc_id", "text", "source").collect()), key=repr)


def test_stages_are_the_dealt_ones_and_keep_the_columns(stages):
    assert [name for name, _ in STAGES] == NAMES and ORACLE_SQL is None
    for name in NAMES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_classifier_drops_what_it_rejects_and_only_that(stages):
    docs = stages["documents"]
    kept = {r.doc_id for r in classify(docs).filter("kept").collect()}
    assert held(stages["classify_quality"]) == held(docs.filter(F.col("doc_id").isin(list(kept))))
    left = [t for _, t, _ in held(stages["classify_quality"])]
    assert all(t and "###" not in t and "y$" not in t for t in left) and len(left) >= 80


def test_one_of_each_class_of_near_copies_stays(stages):
    rows = held(stages["classify_quality"])
    words = [t.split() for _, t, _ in rows]
    low = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            longer = max(len(words[i]), len(words[j]))
            short = min(len(words[i]), len(words[j]))
            if short >= 0.8 * longer and (words[i] == words[j] or lcs(words[i], words[j]) >= 0.8 * longer):
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    best = {}
    for k, (doc_id, _, _) in zip(low, rows, strict=True):
        best[k] = min(best.get(k, doc_id), doc_id)
    assert {r[0] for r in held(stages["drop_near_copies"])} == set(best.values())
    assert len(best) < len(rows)


def test_secrets_are_hidden_and_clean_texts_left_alone(stages):
    before = {i: (t, s) for i, t, s in held(stages["drop_near_copies"])}
    after = {i: (t, s) for i, t, s in held(stages["hide_secrets"])}
    assert before.keys() == after.keys()
    hidden = [i for i in before if before[i] != after[i]]
    assert {i for i in before if BASE.search(before[i][0])} <= set(hidden) and len(hidden) >= 6
    assert not any(BASE.search(t) for t, _ in after.values())
    lengths = stages["hide_secrets"].filter(F.col("n_chars") != F.length("text"))
    assert lengths.isEmpty()


def test_documents_are_repeated_as_drawn(stages):
    rows = held(stages["hide_secrets"])
    size = Counter()
    for _, text, source in rows:
        size[source] += len(text)
    wanted = {s: queries.WEIGHTS.get(s, 1.0) for s in size}
    expected = Counter()
    for doc_id, text, source in rows:
        rate = wanted[source] / sum(wanted.values()) * sum(size.values()) / size[source]
        draw = int(hashlib.md5(f"{queries.SEED}:{doc_id}".encode()).hexdigest()[:12], 16) / 2**48
        n, p = 0, math.exp(-rate)
        total = p
        while total <= draw:
            n += 1
            p *= rate / n
            total += p
        expected[doc_id, text, source] = n
    assert Counter(held(stages["mix_sources"])) == +expected


def test_pieces_are_those_of_all_copies(stages):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    expected = Counter()
    for doc_id, text, _ in held(stages["mix_sources"]):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        first = len(ids) % queries.CAPACITY or queries.CAPACITY
        cuts = [0, *range(first, len(ids) + 1, queries.CAPACITY)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = stages["pack"].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    check_places(got, queries.CAPACITY)
    assert max(r.length for r in got) == queries.CAPACITY


def test_whole_run_and_edge_tables(spark, stages, tmp_path):
    stages["documents"].write.parquet(f"{tmp_path}/a/documents.parquet")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = run(spark, f"{tmp_path}/a").select(names)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, stages["pack"].select(names).collect()))
    empty = spark.createDataFrame([], DOCUMENT)
    empty.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert run(spark, f"{tmp_path}/b").collect() == []
    rng = random.Random(1)
    odd = [(None, prose(rng, 60), None, None, None) for _ in range(30)]
    odd += [(7, prose(rng, 60), None, "src1", 1)] * 3 + [(8, None, None, None, None)]
    docs = spark.createDataFrame(odd, DOCUMENT)
    for name in ("node", "bag", "copy", "row", "uid", "spans", "k1", "votes", "draw"):
        docs = docs.withColumn(name, F.lit("own"))
    docs.write.parquet(f"{tmp_path}/c/documents.parquet")
    got = run(spark, f"{tmp_path}/c").collect()
    check_places(got, queries.CAPACITY)
    # Rows without an id draw each for itself; their source has a quarter of the weight.
    assert 0 < len([r for r in got if r.doc_id is None]) < 30
