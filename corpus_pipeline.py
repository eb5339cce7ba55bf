"""Corpus pipeline: rules, near duplicates, secrets, mixture, tokens.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ombrage.llm import mixing, near_text, piece_coding, quality_rules, secret_scan
from ombrage.llm.common import read_table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; common lines go from the rest."""
    return quality_rules.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, that with the smallest id."""
    return near_text.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by calibrated probabilities; none comes twice."""
    return mixing.mix(docs, repeat=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and the decoded text."""
    return piece_coding.encode_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scans", secrets),
    ("mixing", mixture),
    ("piece_coding", tokens),
]

#: SQL can't express fingerprints, secrets by token counts or piece coding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
