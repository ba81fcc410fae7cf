from pyspark.sql import functions as F

from tillcast.llm.licenses import scan_licences

SCHEMA = "doc_id long, text string, path string"
MIT = "Released under the MIT License."


def test_nearest_ancestor_and_own(spark):
    rows = [
        (1, f"{MIT}", "a/LICENSE"), (2, "prose without any", "a/b/c/x"), (3, "other words", "d/y"),
        (4, "long " * 50 + "\nLicensed under CC BY-NC 4.0.\nmore", "a/b/z"),
        (5, "Licensed under the Apache License, Version 2.0.", "a/b/COPYING"), (6, "text", "a/w"),
        (7, "This licence line names nothing at all of use whatsoever", "d/v"), (8, None, None),
        (8, "", "a/b/e"), (9, "Subject to the terms of the Mozilla Public License, version 2.0.", "top"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("line", F.lit(1)).withColumn("uid", F.lit(1))
    got = {(r.doc_id, r.path): (r.own_licence, r.licence, r.inherited_from) for r in scan_licences(docs, F.col("path")).collect()}
    assert got == {
        (1, "a/LICENSE"): ("MIT", "MIT", None), (2, "a/b/c/x"): (None, "Apache-2.0", "a/b"),
        (3, "d/y"): (None, "MPL-2.0", ""), (4, "a/b/z"): ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        (5, "a/b/COPYING"): ("Apache-2.0", "Apache-2.0", None), (6, "a/w"): (None, "MIT", "a"),
        (7, "d/v"): (None, "MPL-2.0", ""), (8, None): (None, None, None),
        (8, "a/b/e"): (None, "Apache-2.0", "a/b"), (9, "top"): ("MPL-2.0", "MPL-2.0", None),
    }


def test_empty(spark):
    assert scan_licences(spark.createDataFrame([], SCHEMA), F.col("path")).collect() == []
    plain = spark.createDataFrame([(1, "nothing", "p")], SCHEMA)
    assert scan_licences(plain, F.col("path")).first().licence is None
