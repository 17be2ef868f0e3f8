"""Corpus pipeline: documents through stages, each an operator of the llm subpackage.

Every stage takes the rows that the stage before it has kept, as a Parquet table, and its decisions
take effect: rejected documents go, one document of each near-duplicate group stays, personal data
is replaced, sources are mixed to their weights, and the last stage returns tokens.

In every stage null and empty texts count as empty (the quality rules reject them), texts are read whole
whatever their length, repeated rows share a fate, an empty table gives an empty result, and extra
columns pass untouched, whatever their names; the operators' docstrings say the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, neardup, pii, quality, sentpiece
from tessera.llm.shared import Tables


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_documents(docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near-duplicates."""
    return neardup.one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and tokens of each document."""
    return sentpiece.encode_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("neardup", neardup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: SQL can't express MinHash components nor the tokens; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
