"""Merkle fixity audit of WARC replicas.

A replica is a set of archives, an archive a sequence of records at byte offsets. Records
are written as WARC bytes and hashed; the hashes of up to ``fanout`` records in offset
order are hashed again for their offset range, those ranges for wider ones, up to one root
per archive. Two replicas are compared by their roots, and only below ranges that differ
are the children compared, level by level, down to the records at fault. The audit so moves
a hash per archive, and a few per fault, not the records.

Levels are built by aggregation over all archives at once. An archive's first level holds
one row for each ``fanout`` records, so wide ranges stay small groups at any size.

Null urls and bodies are empty, null ids sort first. A null archive is an archive like others;
:func:`bounded_archives` deals pages without an id to archives of their own instead. Records of equal id are ordered by
url and body; equal records are records of their own. Records that one replica lacks
change every hash after them, as offsets shift. Empty replicas have no roots and no faults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillcast.staging import stage

FANOUT = 16


def warc_record(url: Column, body: Column) -> Column:
    """Bytes of a response record without a clock or random id, so that copies are equal."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, archive: Column) -> DataFrame:
    """archive, nth record in it, offset, length, page_id and SHA-256 of each page's record.

    ``archive`` bounds the records that are put in order together.
    """
    picked = pages.select(
        archive.alias("archive"), F.col("page_id").cast("long"), F.col("url").cast("string"),
        warc_record(F.col("url").cast("string"), F.col("html").cast("string")).alias("record"),
    )
    # The order needs no body: only its hash and length go through the shuffle.
    slim = picked.select(
        "archive", "page_id", "url",
        F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("digest"),
    )
    order = W.partitionBy("archive").orderBy("page_id", "url", "digest")
    return slim.select(
        "archive",
        (F.row_number().over(order) - 1).cast("long").alias("nth"),
        (F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("length")).alias(
            "offset"
        ),
        "length", "page_id", "digest",
    )


def bounded_archives(pages: DataFrame, size: int) -> Column:
    """Archives of ``size`` page numbers for ``pages`` and its replicas.

    Pages without a number go, by a hash of url and body, to as many archives as hold about
    ``size`` of them each. These are numbered from the least long, below all others. Such a page
    has no name but its content, so a changed copy is missing and extra.
    """
    without = pages.filter(F.col("page_id").isNull()).count()
    dealt = F.pmod(F.xxhash64("url", "html"), F.lit(max(1, -(-without // size))))
    return F.coalesce(F.floor(F.col("page_id") / size), F.lit(-(2**63)) + dealt)


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Join by equal ``names``, where nulls are equal, with those columns once."""
    other = right.select(*(F.col(c).alias(f"_{c}" if c in names else c) for c in right.columns))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    joined = left.join(other, on, how)
    if how == "left_semi":
        return joined
    # Of a full join's row, one side may be absent.
    own = [F.coalesce(c, f"_{c}").alias(c) if c in names else F.col(c) for c in left.columns]
    return joined.select(*own, *(c for c in right.columns if c not in names))


def tree(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """All nodes of the archives' trees: archive, level (0 for records), nth, start, stop
    (the offset range) and hash. A record's hash covers its place, so moved records differ.
    """
    level = leaves.select(
        "archive", F.lit(0).alias("level"), "nth", F.col("offset").alias("start"),
        (F.col("offset") + F.col("length")).alias("stop"),
        F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256).alias("hash"),
    )
    nodes = level = stage(level, "leaves")
    height = 0
    while level.filter("nth > 0").limit(1).count():
        height += 1
        children = F.sort_array(F.collect_list(F.struct("nth", "hash")))
        level = stage(
            level.groupBy("archive", F.floor(F.col("nth") / fanout).alias("parent")).agg(
                F.min("start").alias("start"), F.max("stop").alias("stop"),
                F.sha2(F.concat_ws("", F.transform(children, lambda c: c["hash"])), 256)
                .alias("hash"),
            ).select("archive", F.lit(height).alias("level"), F.col("parent").alias("nth"),
                     "start", "stop", "hash"),
            "ranges",
        )
        nodes = nodes.unionByName(level)
    return nodes


def faults(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records whose hashes differ: archive, nth and what is wrong with their replica.

    An archive that one side lacks, or has with fewer records, is told record by record.
    """
    ours, theirs = stage(ours, "ours"), stage(theirs, "theirs")
    tops = [t.agg(F.max("level")).first()[0] for t in (ours, theirs)]
    height = max((top for top in tops if top is not None), default=0)
    joined = ["archive", "nth"]

    def compared(level: int, within: DataFrame | None) -> DataFrame:
        sides = []
        for side, name in ((ours, "ours"), (theirs, "theirs")):
            rows = side.filter(F.col("level") == level).select(*joined, F.col("hash").alias(name))
            if within is not None:
                parent = rows.withColumn("above", F.floor(F.col("nth") / fanout))
                rows = _same(parent, within, ["archive", "above"], "left_semi").drop("above")
            sides.append(rows)
        both = _same(sides[0], sides[1], joined, "full")
        return both.filter(~F.col("ours").eqNullSafe(F.col("theirs")))

    # Trees of unequal height have no common range above the lower one.
    level = min((top for top in tops if top is not None), default=0) if None not in tops else 0
    differing = compared(level, None)
    for below in range(level - 1, -1, -1):
        above = stage(differing.select("archive", F.col("nth").alias("above")), "differing")
        differing = compared(below, above)
    state = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra")
    return differing.select(*joined, state.otherwise("changed").alias("state"))


def audit(pages: DataFrame, replica: DataFrame, archive: Column, fanout: int = FANOUT) -> DataFrame:
    """Each record of ``pages`` with its place, digest, its archive's root and the state of
    its replica: same, changed or missing; records only the replica has are extra."""
    ours = stage(records(pages, archive), "ours")
    theirs = stage(records(replica, archive), "theirs")
    our_tree = stage(tree(ours, fanout), "tree")
    wrong = stage(faults(our_tree, tree(theirs, fanout), fanout), "wrong")
    roots = (
        our_tree.groupBy("archive").agg(F.max_by("hash", "level").alias("root"))
    )
    extra = _same(wrong.filter("state = 'extra'"), theirs, ["archive", "nth"], "inner")
    extra = _same(extra, roots, ["archive"], "left")
    known = _same(_same(ours, roots, ["archive"], "inner"), wrong, ["archive", "nth"], "left")
    columns = ["archive", "nth", "offset", "length", "page_id", "digest", "root"]
    return known.select(*columns, F.coalesce("state", F.lit("same")).alias("state")).unionByName(
        extra.select(*columns, "state")
    )
