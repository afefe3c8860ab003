"""One query per corpus operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import (
    embedding_dedup,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    sentencepiece_dropout,
    sharding,
    simhash,
    token_output,
    url_filter,
)
from palimpsest.llm.tokens import vocabulary_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_and_read(_table(spark, sf_dir, "documents"), vocabulary_path())


def op6_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_dropout.report(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.report(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_quality_rules,
        op3_url_filter,
        op4_quality_classifier,
        op5_token_output,
        op6_sentencepiece_dropout,
        op7_packing,
        op8_sharding,
        op9_simhash,
        op10_embedding_dedup,
    )
}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express.

    The learned score, the tokens, the fingerprints and the hashed neighbours
    have none; tests hold those against brute force.
    """
    return {
        "op1_pii": pii.ORACLE_SQL,
        "op2_quality_rules": quality_rules.ORACLE_SQL,
        "op3_url_filter": url_filter.oracle_sql(),
        "op8_sharding": sharding.oracle_sql(),
    }
