"""Documents through the stages of a training-data pipeline, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmill.llm.bpe_monoid import token_digests
from trailmill.llm.jaccard_groups import one_of_each
from trailmill.llm.language_fusion import of_known_language
from trailmill.llm.secret_ownership import redact_secrets
from trailmill.llm.template_leaks import without_leaks
from trailmill.session import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay."""
    return of_known_language(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near copies stays: five words, similarity 0.8."""
    return one_of_each(docs, width=5, num=80, den=100)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are replaced by a mark; every document stays."""
    return redact_secrets(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return token_digests(docs)


STAGES = [
    ("language", known_language),
    ("copies", without_copies),
    ("benchmarks", without_benchmarks),
    ("secrets", without_secrets),
    ("tokens", tokenized),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
