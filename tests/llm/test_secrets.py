import hashlib
import math
import re
from itertools import product

from tillcast.llm.secrets import (
    base_spans,
    context_values,
    find_secrets,
    guess_cost,
    mask_secrets,
)

KEY = "AKIA" + "A1B2C3D4E5F6"
HEX = "0123456789abcdef" * 2


def brute(text):
    spans = []
    pattern = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.I | re.A,
    )
    spans += [(m.start(), 0, m.end()) for m in pattern.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


TEXTS = [
    "", "no", f"Token = '{HEX}' and {KEY}", "password:short token=longenough1",
    "API_KEY: \"abcdefgh\" apikey=ABCDEFGH.", "ſecret=abcdefghi toKen=abcdefghi", f"é😀 secret={KEY}",
    "token=secret=abcdefgh", f"{HEX}{HEX}x{HEX[:31]}", "AKIAAKIA" + "X" * 7, "AKIA" * 4 + "é" + KEY,
    "password = = aaaaaaaaaa", "token:\nabcdefgh1",
]


def test_base_spans_equal_brute_force():
    for a, b in product(TEXTS, repeat=2):
        assert base_spans(a + " " + b) == brute(a + " " + b)


def test_guess_cost_takes_the_cheapest_reading():
    words = {"correct": 2.0, "horse": 2.5}
    assert guess_cost("correct", words) == 2.0
    assert guess_cost("Correcthorse", words) == 2.0 + 0.3 + 2.5 + 0.5
    assert abs(guess_cost("c0rrect", words) - 2.3) < 1e-9
    assert guess_cost("zq!", {}) == 2 * math.log10(26) + math.log10(33)
    assert guess_cost("2019-12-31", {}) < 6 < guess_cost("9120-93-21", {})
    assert guess_cost("qwertyuiop", {}) < 5 < guess_cost("qmwnebrvtc", {})
    assert guess_cost("abxabxabxabx", {}) < guess_cost("abx", {}) + 1
    assert guess_cost("xK9#mQ2$vL7!", {}) > 13
    assert guess_cost("", {}) == 0


def test_context_values_and_query(spark, documents):
    strong = "xK9#mQ2$vL7!pR4z"
    texts = [
        f"The password is {strong}, keep it.", "The password is monday monday monday",
        "pwd: qwertyuiop", f"token = '{HEX}'", None, "",
    ]
    words = ["monday"] * 9
    got = {r.doc_id: r for r in find_secrets(documents([*texts, *words])).collect()}
    assert got[0].spans == f"guess:16:{16 + len(strong)}" and got[0].n_guess == 1
    assert got[1].spans == got[2].spans == "" and got[1].guess_power < got[2].guess_power < 10
    assert got[3].spans == "assign:0:41,hex:9:41" and got[3].n_assign == got[3].n_hex == 1
    assert got[3].base_sha256 == hashlib.sha256(got[3].spans.encode()).hexdigest()
    assert got[4].spans == got[5].spans == "" and got[4].guess_power is None
    assert got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert context_values(f"secret: {HEX}", brute(f"secret: {HEX}")) == []


def test_mask(spark, documents):
    rows = [(1, f"a token = '{HEX}' b"), (1, f"a token = '{HEX}' b"), (None, f"{KEY}"), (2, None), (3, "x")]
    docs = documents(rows)
    docs = docs.withColumn("k1", docs.lang).withColumn("spans", docs.lang)
    out = mask_secrets(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=repr)
    assert got == sorted([
        (1, "a [SECRET]' b", 13), (1, "a [SECRET]' b", 13), (None, "[SECRET]", 8), (2, None, 0), (3, "x", 1),
    ], key=repr)
    assert mask_secrets(documents([])).collect() == []
    assert find_secrets(documents([])).collect() == []


def test_values_that_a_base_span_only_begins(spark, documents):
    value = "Tr0ubadour&3xtra!x"
    text = f"password: {value} end"
    base = brute(text)
    assert base == [(0, 0, 20)]
    assert context_values(text, base) == [(10, 10 + len(value), value)]
    docs = documents([text, f"token = '{HEX}'"])
    got = {r.doc_id: r for r in find_secrets(docs).collect()}
    assert got[0].spans == f"assign:0:20,guess:10:{10 + len(value)}"
    assert (got[0].n_assign, got[0].n_guess, got[1].n_guess) == (1, 1, 0)
    assert {r.doc_id: r.text for r in mask_secrets(docs).collect()}[0] == "[SECRET] end"
