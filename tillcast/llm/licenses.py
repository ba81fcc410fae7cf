"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along directories.

Header lines are all lines of a text that hold a licence word. Each different line becomes
a sparse vector of term counts weighted by how rare a term is among header lines of the
whole corpus, and is compared with the templates' vectors in a join on terms. The nearest
template names the line's licence if the cosine reaches ``least``; a text's licence is that
of its nearest line. A text that mostly consists of such lines is a licence file and holds
for its directory. A text without a licence of its own takes that of its nearest ancestor
directory with a licence file, by a join on paths.

Everything is built-in functions. Templates are a parameter of at most ``MOST_TEMPLATES``
rows, which bounds what is broadcast. Null and empty texts have no header lines; a null
path has no directory and inherits nothing. Ties of cosine go to the smaller name, ties of
licence files to the greater cosine, then the smaller name. Repeated rows keep a row each.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.staging import stage

HEADER = r"(?i)licen[cs]e|copyright|spdx|warrant|redistribut|public domain"
TERM = "[a-z0-9]+"
#: Least cosine to a template; least share of a licence file's words in header lines.
LEAST, FILE_SHARE = 0.5, 1 / 3
MOST_TEMPLATES = 1000

# Short notices by which works name their licence.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without "
    "modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _norms(weighted: DataFrame, key: str) -> DataFrame:
    return weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def line_licences(lines: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """``lines`` (line, n occurrences) with licence and cosine, where one is near enough."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    spark = lines.sparkSession
    counted = lines.select("line", "n", F.explode(_terms(F.col("line"))).alias("term"))
    counted = stage(counted.groupBy("line", "n", "term").agg(F.count("*").alias("tf")), "terms")
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    known = spark.createDataFrame(list(templates.items()), "licence string, notice string")
    known = known.select("licence", F.explode(_terms(F.col("notice"))).alias("term"))
    known = known.groupBy("licence", "term").agg(F.count("*").alias("tf"))
    rare = counted.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    # One row of totals; the templates are bounded above.
    notices = (
        known.join(rare, "term", "left")
        .join(F.broadcast(total))
        .select("licence", "term", (F.col("tf") * idf).alias("w"))
    )
    notices = stage(notices, "notices")
    notices = notices.join(F.broadcast(_norms(notices, "licence")), "licence").select(
        "licence", "term", (F.col("w") / F.col("norm")).alias("unit")
    )
    weighted = stage(
        counted.join(rare, "term")
        .join(F.broadcast(total))
        .select("line", "term", (F.col("tf") * idf).alias("w")),
        "weighted",
    )
    dots = (
        weighted.join(F.broadcast(notices), "term")
        .groupBy("line", "licence")
        .agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    )
    near = dots.join(_norms(weighted, "line"), "line").select(
        "line", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")
    )
    best = F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), "licence"))
    return (
        near.filter(F.col("cosine") >= least)
        .groupBy("line")
        .agg(best.alias("best"))
        .select("line", "best.*")
    )


def _directory(path: Column) -> Column:
    """What stands before the last slash; the root is the empty path."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licences(
    docs: DataFrame,
    path: Column,
    templates: dict[str, str] | None = None,
    least: float = LEAST,
    file_share: float = FILE_SHARE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, path, its own licence with cosine, whether it is
    a licence file, the licence that holds and the directory that it comes from."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = text.rlike(HEADER)
    lines = F.when(some, F.filter(F.split(text, "\n"), lambda x: x.rlike(HEADER))).otherwise(
        F.array().cast("array<string>")
    )
    rows = docs.select(
        F.col("doc_id").cast("long"), path.cast("string").alias("path"), lines.alias("lines"),
        F.when(some, F.size(_terms(text))).otherwise(0).alias("n_terms"),
    )
    rows = stage(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    found = rows.select("uid", "n_terms", F.explode("lines").alias("line"))
    different = stage(found.groupBy("line").agg(F.count("*").alias("n")), "lines")
    named = stage(line_licences(different, templates or TEMPLATES, least), "named")
    own = (
        found.join(named, "line")
        .groupBy("uid")
        .agg(
            F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), "licence")).alias("best"),
            F.sum(F.size(_terms(F.col("line")))).alias("own_terms"),
        )
    )
    told = rows.drop("lines").join(own, "uid", "left").select(
        "doc_id", "path", _directory(F.col("path")).alias("dir"),
        F.col("best.licence").alias("own"), F.col("best.cosine").alias("cosine"),
        F.coalesce(F.col("own_terms") >= file_share * F.col("n_terms"), F.lit(False)).alias("is_file"),
    )
    told = stage(told, "told")
    held = (
        told.filter(F.col("is_file") & F.col("dir").isNotNull())
        .groupBy("dir")
        .agg(F.min_by("own", F.struct(-F.col("cosine"), "own")).alias("licence"))
    )
    # Each different directory looks for its nearest ancestor, itself first.
    places = told.select("dir").filter(F.col("dir").isNotNull()).distinct()
    steps = F.split("dir", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(steps)),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("above")),
    )
    nearest = (
        places.select("dir", F.explode(above).alias("a"))
        .select("dir", "a.*")
        .join(held.withColumnRenamed("dir", "above"), "above")
        .groupBy("dir")
        .agg(F.max_by(F.struct("licence", "above"), "depth").alias("from"))
    )
    nearest = stage(nearest, "nearest")
    return told.join(nearest, "dir", "left").select(
        "doc_id", "path",
        F.col("own").alias("own_licence"),
        "cosine", "is_file",
        F.coalesce("own", "from.licence").alias("licence"),
        F.when(F.col("own").isNull(), F.col("from.above")).alias("inherited_from"),
    )
