"""A corpus pipeline: toxic documents go, one of each group of near copies stays, secrets are
blotted out, sources are mixed to target weights, and the mix is packed into training sequences.

Every stage takes all rows that the one before kept, and all but the last return the columns of
``documents``. Stages hand over Parquet tables in the shared folder, so a lost executor costs the
tasks of one stage; a table goes when the next stage's is whole.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables (which stay
empty), and keeps further columns, whatever their names, but for the last, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexlake.llm import mixing, ngram_join, packing, secret_scan, toxicity
from lexlake.llm.common import forget, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, doesn't reject. Null and empty texts score as any text
    without features; equal texts are kept or go together; rows without doc_id have no label and are scored."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % of five-word shingles or more: the one with the smallest doc_id, of repeated rows of it the
    first by text. Texts without words, null ones too, and rows without doc_id are linked with nothing and stay."""
    return ngram_join.one_of_each(docs, ngram_join.Rule(5, 80))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars to match. A null text stays null; repeated rows are changed alike; a secret
    may be as long as its text."""
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often and as far as the mix takes them, in the order of its slots. A null source is a source of its own; texts without
    words have no size and are not taken; repeated rows are documents each; ties in order are broken by hashes of doc_id and text."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences. A null or empty text has its end id alone; repeated rows are packed each; a document longer than a
    window is cut into several; texts equally near a seed are taken in the order of their shard."""
    return packing.report(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", one_of_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the learned classifier and the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
