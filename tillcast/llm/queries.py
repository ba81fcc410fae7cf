"""The registered queries of this subpackage and their SQL, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.alignment import align_tokens
from tillcast.llm.decision_list import quality_rules
from tillcast.llm.fixity import audit, bounded_archives
from tillcast.llm.licenses import TEMPLATES, scan_licences
from tillcast.llm.metric_join import metric_components
from tillcast.llm.mixing import poisson_mix
from tillcast.llm.order_minhash import near_duplicates
from tillcast.llm.packing import pack_documents
from tillcast.llm.secrets import find_secrets
from tillcast.llm.spelling import spelling_forms
from tillcast.llm.substring import remove_repeated
from tillcast.llm.token_counts import count_tokens
from tillcast.llm.weak_labels import classify

Query = Callable[[SparkSession, str], DataFrame]

SEED = 42
#: Two sources wanted more, one less, the others alike; weights need not sum to one.
WEIGHTS = {"src0": 1.0, "src1": 3.0, "src2": 2.0}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CAPACITY = 2048


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))


def op2_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """Archives of 500 page numbers, against a replica in which some bodies have decayed and
    the last page of some archives is lost (both by digest, so they follow the data). Pages
    without a number are in archives of their own; the SQL leaves them out."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    mark = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    decayed = F.when(mark == "00", F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    lost = (F.col("page_id") % 500 == 499) & (mark >= "80")
    replica = pages.withColumn("html", decayed).filter(~F.coalesce(lost, F.lit(False)))
    return audit(pages, replica, bounded_archives(pages, 500))


def op4_metric_join(spark: SparkSession, folder: str) -> DataFrame:
    return metric_components(spark.read.parquet(f"{folder}/embeddings.parquet"), 0.98)


def op3_guess_cost(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(documents(spark, folder))


def op5_decision_list(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality_rules(documents(spark, folder), labels)


def op6_suffix_automata(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated(documents(spark, folder), with_text=False).drop("kept")


def op7_licence_inheritance(spark: SparkSession, folder: str) -> DataFrame:
    """Documents lie in a directory for their source and language."""
    return scan_licences(documents(spark, folder), F.concat_ws("/", "source", "lang", "doc_id"))


def op8_certified_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder), TOKENIZER, CAPACITY)


def op9_weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    return classify(documents(spark, folder))


def op10_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    return poisson_mix(documents(spark, folder), WEIGHTS, SEED, default_weight=1.0)


def op11_pivotal_grams(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_forms(documents(spark, folder))


def op12_rank_merging(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(documents(spark, folder), TOKENIZER)


def op13_incidence_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokens(documents(spark, folder), TOKENIZER, PIECES)


QUERIES: dict[str, Query] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_merkle_fixity": op2_merkle_fixity,
    "op4_metric_join": op4_metric_join,
    "op3_guess_cost": op3_guess_cost,
    "op5_decision_list": op5_decision_list,
    "op6_suffix_automata": op6_suffix_automata,
    "op7_licence_inheritance": op7_licence_inheritance,
    "op8_certified_packing": op8_certified_packing,
    "op9_weak_labels": op9_weak_labels,
    "op10_poisson_mix": op10_poisson_mix,
    "op11_pivotal_grams": op11_pivotal_grams,
    "op12_rank_merging": op12_rank_merging,
    "op13_incidence_alignment": op13_incidence_alignment,
}

_POISSON = f"""
WITH RECURSIVE held AS (
  SELECT source, sum(coalesce(length(text), 0)) AS held FROM documents GROUP BY source
), wanted AS (
  SELECT source, held, CASE source {" ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items())}
    ELSE 1.0 END::DOUBLE AS wanted FROM held
), rates AS (
  SELECT source, CASE WHEN held > 0 THEN (wanted / (SELECT sum(wanted) FROM wanted))
    * ((SELECT sum(held) FROM held)::DOUBLE / held::DOUBLE) ELSE 0.0 END AS rate FROM wanted
), cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS s FROM rates WHERE rate > 0
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1)::DOUBLE, s + p * rate / (k + 1)::DOUBLE
  FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 12)
), drawn AS (
  SELECT d.*, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT
    / 281474976710656.0::DOUBLE AS draw FROM documents d
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
    (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.s <= d.draw) AS n,
    (SELECT r.rate FROM rates r WHERE r.source IS NOT DISTINCT FROM d.source) AS rate
  FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(n))::INTEGER AS copy
FROM counted WHERE n > 0 AND rate > 0
"""

_LINKS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e)
    / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
), smallest AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id,
  vec_id = component_id AS kept
FROM v JOIN smallest ON node = vec_id
"""

#: The tree of archives of up to 500 records: leaves, 32 ranges, 2 ranges and, if any archive
#: has both, the root.
_FIXITY = """
WITH bytes AS (
  SELECT floor(page_id / 500)::BIGINT AS archive, page_id, url,
    'WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: ' || coalesce(url, '')
    || '\r\nContent-Length: ' || strlen(coalesce(html, '')) || '\r\n\r\n' || coalesce(html, '')
    || '\r\n\r\n' AS record,
    substr(md5(page_id::VARCHAR), 1, 2) AS mark
  FROM pages
), leaf AS (
  SELECT archive, row_number() OVER o - 1 AS nth, page_id, strlen(record) AS length,
    (sum(strlen(record)) OVER o - strlen(record))::BIGINT AS offset, sha256(record) AS digest, mark
  FROM bytes WINDOW o AS (PARTITION BY archive ORDER BY page_id, url, sha256(record))
), l0 AS (
  SELECT archive, nth, sha256(concat_ws(':', "offset", length, digest)) AS hash FROM leaf
), l1 AS (
  SELECT archive, nth // 16 AS nth, sha256(string_agg(hash, '' ORDER BY l0.nth)) AS hash
  FROM l0 GROUP BY archive, l0.nth // 16
), l2 AS (
  SELECT archive, nth // 16 AS nth, sha256(string_agg(hash, '' ORDER BY l1.nth)) AS hash
  FROM l1 GROUP BY archive, l1.nth // 16
), l3 AS (
  SELECT archive, CASE WHEN (SELECT max(nth) FROM l2) = 0 THEN min(hash)
    ELSE sha256(string_agg(hash, '' ORDER BY l2.nth)) END AS root FROM l2 GROUP BY archive
), moved AS (
  SELECT *, coalesce(max(CASE WHEN mark = '00' THEN 1 ELSE 0 END) OVER (
    PARTITION BY archive ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shifted
  FROM leaf
)
SELECT m.archive, nth, "offset", length, page_id, digest, root,
  CASE WHEN page_id % 500 = 499 AND mark >= '80' THEN 'missing'
    WHEN mark = '00' OR shifted = 1 THEN 'changed' ELSE 'same' END AS state
FROM moved m JOIN l3 ON m.archive = l3.archive
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LICENCES = f"""
WITH notice AS (
  SELECT * FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())})
    t(licence, notice)
), rows AS (
  SELECT row_number() OVER () AS uid, doc_id, concat_ws('/', source, lang, doc_id) AS path,
    concat_ws('/', source, lang) AS dir, coalesce(text, '') AS text FROM documents
), line AS (
  SELECT uid, unnest(string_split(text, chr(10))) AS line FROM rows
), header AS (
  SELECT * FROM line WHERE regexp_matches(line,
    '(?i)licen[cs]e|copyright|spdx|warrant|redistribut|public domain')
), lines AS (SELECT line, count(*) AS n FROM header GROUP BY line
), total AS (SELECT coalesce(sum(n), 0) AS total FROM lines
), term AS (
  SELECT line, n, term, count(*) AS tf FROM (
    SELECT line, n, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM lines
  ) GROUP BY line, n, term
), rare AS (SELECT term, sum(n) AS df FROM term GROUP BY term
), ours AS (
  SELECT line, term, tf * (ln((1 + total)::DOUBLE / (1 + df)) + 1) AS w
  FROM term JOIN rare USING (term), total
), theirs AS (
  SELECT licence, term, tf * (ln((1 + total)::DOUBLE / (1 + coalesce(df, 0))) + 1) AS w
  FROM (SELECT licence, term, count(*) AS tf FROM (
    SELECT licence, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) AS term FROM notice
  ) GROUP BY licence, term) LEFT JOIN rare USING (term), total
), one AS (SELECT line, sqrt(sum(w * w)) AS norm FROM ours GROUP BY line
), two AS (SELECT licence, sqrt(sum(w * w)) AS norm FROM theirs GROUP BY licence
), near AS (
  SELECT line, licence, round(sum(o.w * t.w) / (any_value(one.norm) * any_value(two.norm)), 6) AS cosine
  FROM ours o JOIN theirs t USING (term) JOIN one USING (line) JOIN two USING (licence)
  GROUP BY line, licence
), named AS (
  SELECT line, licence, cosine FROM near WHERE cosine >= 0.5
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY cosine DESC, licence) = 1
), own AS (
  SELECT uid, arg_min(licence, (-cosine, licence)) AS own, max(cosine) AS cosine,
    sum(len(regexp_extract_all(lower(line), '[a-z0-9]+'))) AS own_terms
  FROM header JOIN named USING (line) GROUP BY uid
), told AS (
  SELECT doc_id, path, dir, own, cosine, coalesce(own_terms >=
    1/3::DOUBLE * len(regexp_extract_all(lower(text), '[a-z0-9]+')), false) AS is_file
  FROM rows LEFT JOIN own USING (uid)
), held AS (
  SELECT dir, arg_min(own, (-cosine, own)) AS licence FROM told WHERE is_file GROUP BY dir
)
SELECT doc_id, path, own AS own_licence, cosine, is_file, coalesce(own, held.licence) AS licence,
  CASE WHEN own IS NULL THEN held.dir END AS inherited_from
FROM told LEFT JOIN held ON told.dir = held.dir
"""

ORACLES: dict[str, str] = {
    "op2_merkle_fixity": _FIXITY,
    "op4_metric_join": _LINKS,
    "op7_licence_inheritance": _LICENCES,
    "op10_poisson_mix": _POISSON,
}
