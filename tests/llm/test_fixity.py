import hashlib

from pyspark.sql import functions as F

from tillcast.llm.fixity import audit, faults, records, tree
from tillcast.llm.queries import op2_merkle_fixity

SCHEMA = "page_id long, url string, html string"


def pages(spark, n):
    return spark.createDataFrame([(i, f"http://h/{i}", f"<p>é{i}</p>") for i in range(n)], SCHEMA)


def test_states_and_descent(spark):
    ours = pages(spark, 70)
    theirs = ours.filter("page_id != 69").withColumn(
        "html", F.when(F.col("page_id") == 5, "<p>éX</p>").otherwise(F.col("html"))
    )
    out = audit(ours, theirs, F.floor(F.col("page_id") / 35), fanout=3).collect()
    states = {r.page_id: r.state for r in out}
    assert {k: v for k, v in states.items() if v != "same"} == {5: "changed", 69: "missing"}
    extra = audit(theirs, ours, F.floor(F.col("page_id") / 35), fanout=3)
    assert {r.page_id for r in extra.filter("state = 'extra'").collect()} == {69}


def test_tree_and_offsets(spark):
    leaves = records(pages(spark, 5), F.lit("a"))
    rows = sorted(leaves.collect(), key=lambda r: r.nth)
    at, hashes = 0, []
    for r in rows:
        body = f"<p>é{r.page_id}</p>".encode()
        record = (
            f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: http://h/{r.page_id}\r\n"
            f"Content-Length: {len(body)}\r\n\r\n"
        ).encode() + body + b"\r\n\r\n"
        digest = hashlib.sha256(record).hexdigest()
        assert (r.offset, r.length, r.digest) == (at, len(record), digest)
        hashes.append(hashlib.sha256(f"{at}:{len(record)}:{digest}".encode()).hexdigest())
        at += len(record)
    while len(hashes) > 1:
        hashes = [
            hashlib.sha256("".join(hashes[i : i + 2]).encode()).hexdigest()
            for i in range(0, len(hashes), 2)
        ]
    nodes = tree(leaves, 2)
    root = nodes.orderBy(F.desc("level")).first()
    assert root.hash == hashes[0] and (root.start, root.stop) == (0, at)
    assert faults(nodes, nodes, 2).collect() == []


def test_edges(spark):
    rows = [(None, None, None), (1, "u", "x"), (1, "u", "x"), (2, "", "")]
    odd = spark.createDataFrame(rows, SCHEMA).withColumn("nth", F.lit("clash"))
    out = audit(odd, odd, F.lit(0)).collect()
    assert len(out) == 4 and {r.state for r in out} == {"same"}
    none = odd.limit(0)
    assert audit(none, none, F.lit(0)).collect() == []
    assert {r.state for r in audit(odd, none, F.lit(0)).collect()} == {"missing"}
    assert {r.state for r in audit(none, odd, F.lit(0)).collect()} == {"extra"}


def test_pages_without_an_id_are_audited(spark, tmp_path):
    numbered = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(30)]
    nameless = [(None, f"http://n/{i}", f"<p>{i}</p>") for i in range(1200)]
    odd = spark.createDataFrame([*numbered, *nameless, (None, None, None), (None, None, None)], SCHEMA)
    odd.write.parquet(f"{tmp_path}/pages.parquet")
    got = op2_merkle_fixity(spark, str(tmp_path)).collect()
    without = [r for r in got if r.page_id is None]
    assert len(got) == 1232 and len(without) == 1202
    assert {r.state for r in without} == {"same"} and None not in {r.archive for r in got}
    own = {r.archive for r in without}
    assert len(own) == 3 and not own & {r.archive for r in got if r.page_id is not None}
    # A null archive is one archive; its faults are found too.
    none = F.lit(None).cast("long")
    lost = audit(odd, odd.filter("page_id IS NULL OR page_id != 29"), none, fanout=4).collect()
    assert len(lost) == 1232 and sum(r.state == "missing" for r in lost) == 1
    back = audit(odd.filter("page_id IS NULL OR page_id != 29"), odd, none, fanout=4)
    assert back.filter("state = 'extra'").count() == 1
