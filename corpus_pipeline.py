"""A corpus pipeline of five stages over the documents table.

Defined results of the stages, beside their operators' own: an empty table gives an
empty result; null texts count as empty, so the second stage rejects them, as it does
all texts of under 50 words; rows with a null doc_id are documents like any other;
repeated rows are judged alike until the third stage, which keeps one of each group;
texts of any length are read whole; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import packing, pii, quality_classifier, quality_rules, simhash
from palimpsest.llm.common import remove_saved, saved
from palimpsest.llm.tokens import vocabulary_path


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; a document at the threshold stays."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a quality rule rejects; a document at a rule's limit stays."""
    return quality_rules.keep_good(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the smallest doc_id, a null one last."""
    return simhash.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text; no row goes."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into training sequences; every id lies in one piece."""
    # Workers hold what earlier stages left, so the encoder takes a third less memory than by default.
    return packing.pack(docs, vocabulary_path(), cache_entries=60_000, chunk_bytes=2 << 20)


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("simhash_near_dedup", simhash_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't express the learned score, the shingle sets or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, name)
            if before is not None:
                remove_saved(before)
            before = docs
    return docs
