"""From raw documents to packed training sequences: each stage's table is the next one's input.

The quality classifier drops what it scores under 0.5; of equal texts one stays, then of near copies one; the
sources are mixed to their target weights, with documents repeated or left out; and the mix is packed into sequences of at most
4096 tokens.

Defined cases, in every stage: null text counts as empty; null doc_id is an id of its own, after all others; null source is a source of its own; rows alike in doc_id and text are
one document for the stages that choose rows; ties go to the smaller doc_id; texts of any length are taken whole; an empty table gives no rows; further columns, whatever
their names, are carried along unread. Empty texts are dropped or kept by their score, are one group of equal texts, have no near copies, and take no words of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import exact_dedup, jaccard, mixing, packing, quality
from sievework.llm.common import materialize, release


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores 0.5 or more."""
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts, up to white space."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, a similarity of 0.8 or more."""
    return jaccard.representatives(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier has no SQL form; tests/llm/test_pipeline_run.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs
