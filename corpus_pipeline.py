"""Stages that turn raw documents into a training corpus, each calling one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder and reads it again for the next stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from archlens.llm import bpe, line_rules, mixing, near_dups, rule_ensemble
from archlens.session import cut_lineage

# no SQL form: trees, signatures and BPE merges are not SQL; tests hold the stages against brute force
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents without their failing lines; ``n_chars`` follows the text."""
    clean = line_rules.keep_clean(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from the labels of these documents, calls good."""
    return rule_ensemble.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dups.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.emit(mixing.mix(docs, weights=[1, 2, 3], max_epochs=3)).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the bytes they decode to."""
    return bpe.round_trip(docs, with_ids=True).select(
        "doc_id", "lang", "source", "bpe.n_tokens", "bpe.ids", "bpe.ids_sha256", "bpe.decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
