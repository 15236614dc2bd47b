"""Corpus pipeline: each stage works on what the one before it kept, written as Parquet and read again.

Defined cases: null, empty and letterless texts are in no language and go first; a document without an id is no
duplicate of another; rows of one id count as one document from the Jaccard join on; masked texts have their
n_chars counted anew; the last stage returns a row for each draw, and an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import op1_ngram_join, op4_secrets, op5_mix, op6_decontaminate, op8_language
from tessera.llm.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in no accepted language go."""
    return op8_language.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group one document stays."""
    return op1_ngram_join.stage(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go."""
    return op6_decontaminate.stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: secrets are masked in the text; all documents stay."""
    return op4_secrets.stage(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row for each time the mix takes a document, with its shard and its place there."""
    return op5_mix.stage(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
]
#: The mix is drawn by seeded hypergeometric splits and the field is trained, which SQL can't express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
