"""Corpus pipeline: quality filter, near-duplicate removal, decontamination, redaction, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns rows; all but the last return the
columns of ``documents``.  ``docs`` is what the stage before has kept, stored as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, decontaminate, jaccard, pii, quality
from gridloom.plans.scratch import bounded_batches, materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of this input."""
    bounded_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: by SimHash first, then by minimum hashes, each link of five-word similarity 0.8 or more."""
    bounded_batches(spark)
    return jaccard.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bounded_batches(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the new text."""
    bounded_batches(spark)
    return pii.redact(docs, length_col="n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the remaining texts."""
    bounded_batches(spark)
    return bpe.digests(docs)


STAGES = [
    ("quality", good_quality),
    ("simhash", one_of_each),
    ("decontaminate", uncontaminated),
    ("pii", redacted),
    ("bpe", encoded),
]

#: The stages rest on trained models, XXH64 and a tokenizer, none of which SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
