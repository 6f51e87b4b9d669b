"""A training corpus from ``documents``: five stages, each an operator of
``codesift.llm`` on all that its predecessor kept.

Every stage but the last returns the columns of ``documents``; each is written
as Parquet and read back as the next one's input.

Defined cases, for every stage: a null text is an empty one; a null doc_id is an
id of its own, after all others; of rows that repeat an id and a text the
deduplicating stages keep one, the others treat each; further columns, whatever
their names, come through all stages but the last; an empty table stays empty;
a very long text is one row of one task in each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codesift.llm import exact_dedup, mixing, packing, simhash, toxicity
from codesift.llm.common import table, word_count
from codesift.session import ensure_checkpoint_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.clean_rows(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.unique_rows(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints of three-word shingles are
    linked within three bits, the one with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs)


def packed_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents in length buckets and batches."""
    return packing.packed_batches(docs.select("doc_id", word_count().alias("n_tokens")))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_buckets),
]

# Classifier, random rounding and dynamic programming are beyond SQL; the
# stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
