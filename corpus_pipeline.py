"""From raw documents to a tokenizable training mix, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` writes each
stage's result as Parquet to the shared folder and reads it again as the next one's
``docs``, so a lost executor never costs more than the stage it was lost in.

Defined results: the stages keep rows with null ids, sources and languages; texts that
are null or empty fail the quality rules; repeated rows are one group of the join, of
which one row stays; an empty table gives an empty result; other columns are kept up to
the last stage, which returns ids and tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlens.llm import bpe, jaccard, mixing, pii, quality
from marketlens.operators.scratch import scratch_table
from marketlens.tables import Tables


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text")  # so that no column meets one of the results
    return quality.judge(rows, Tables(spark, sf_dir).labels).filter("kept").select("_row.*")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (80% of five-word shingles): the one with the group's smallest id."""
    return jaccard.one_of_group(docs, percent=80, shingle=5)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind."""
    return pii.redact(docs, pii.train(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; a document appears as often as it is taken."""
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked by decoding them."""
    return bpe.digest(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("shingle_groups", keep_one_of_group),
    ("personal_data", without_personal_data),
    ("source_mix", mixed),
    ("bpe", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL can't say the hashes, the trees and the trained field; the tests compare with plain Python.
ORACLE_SQL = None
