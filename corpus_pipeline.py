"""From raw documents to packed training sequences.

Quality classifier, near-dedup, secret masking, source mixing and packing follow each
other; each stage reads what its predecessor wrote. All stages but the last return the
columns of ``documents``. Null texts have no words, so the first stage drops them; later
stages still accept them, as their operators do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillcast.llm import queries
from tillcast.llm.mixing import poisson_mix
from tillcast.llm.order_minhash import one_of_each
from tillcast.llm.packing import pack_documents
from tillcast.llm.secrets import mask_secrets
from tillcast.llm.weak_labels import fit, keep_good
from tillcast.staging import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier, fitted on these documents, takes for good."""
    return keep_good(docs, fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; spans of secrets become a mark, and n_chars follows."""
    return mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its Poisson draw says; copies are rows of their own."""
    mixed = poisson_mix(docs, queries.WEIGHTS, queries.SEED, default_weight=1.0)
    return mixed.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and place."""
    return pack_documents(docs, queries.TOKENIZER, queries.CAPACITY)


STAGES: list[tuple[str, Stage]] = [
    ("classify_quality", classify_quality),
    ("drop_near_copies", drop_near_copies),
    ("hide_secrets", hide_secrets),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL can't express trained models, sketches and token ids; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
