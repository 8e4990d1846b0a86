"""Corpus pipeline: toxicity, exact dedup, SimHash near-dedup, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept, and
returns documents with their columns; the last returns the encoded documents.
``run`` writes each stage's rows to the shared checkpoint folder and reads them
again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratewise.llm import block_naming, cnn_toxicity, mixing, popcount_simhash
from ratewise.llm.common import materialize, table
from ratewise.llm.queries import byte_bpe


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't reject."""
    return cnn_toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white-space runs alike) the document with the smallest id."""
    return block_naming.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of fingerprints within 3 bits the document with the smallest id."""
    return popcount_simhash.keep_first(docs, shingle=3, max_bits=3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each pass over its source that takes it."""
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded documents: token ids, counts and digests."""
    return byte_bpe(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_stage),
    ("encoding", encoding),
]

#: SQL can't express the classifier, so there is none; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
