"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's documents.

Every stage takes an empty table, null texts, languages and sources, repeated rows and further columns of any name: rows
without text go in the first stage; repeated rows pass it and line dedup as they are and leave near-dedup as one; further
columns come through all stages but the last. The operators' modules state each case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import common, decontaminate, langid, line_dedup, minhash_dedup, mixing
from rostrum.sources.store import scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a score of at least 0.5; those without letters go."""
    return langid.accepted(docs, langid.fit(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur across documents; those that held nothing else go. n_chars follows the text."""
    return line_dedup.dedup_lines(docs, min_tokens=1).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_dedup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words it takes of each and those that each output shard gets."""
    return mixing.mix_report(docs).where("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mix_sources),
]

#: Language ID is a trained model, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):  # what a stage writes on its way goes with it
            docs = common.settled(stage(spark, docs, sf_dir), f"pipeline-{name}", outlives=True)
    return docs
