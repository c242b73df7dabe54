"""Cleaning a corpus in stages: each one works on all that its predecessor kept, and its decisions take effect.

A stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return exactly the columns of ``docs``, so
they can be left out or put in another order; each result is written to the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfold.llm import bpe, decontaminate, minhash, pii, quality
from nearfold.llm.frames import new_folder
from nearfold.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Robust outliers among the texts of their language and source go; see quality.with_distance."""
    ship(spark)
    return quality.reject_outliers(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays; see minhash.near_duplicates."""
    ship(spark)
    return minhash.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which an item of ``benchmark`` leaks go; see decontaminate.leaks."""
    ship(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds, and n_chars is that of the new text; see pii.redact."""
    ship(spark)
    spans = quality.unused("__spans", docs.columns)
    length = "n_chars" if "n_chars" in docs.columns else None
    return pii.redact(docs, spans=spans, length=length).drop(spans)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their texts, and the text that the ids stand for; see bpe.encode_and_decode."""
    ship(spark)
    return bpe.encode_and_decode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-copies", near_copies),
    ("benchmark leaks", benchmark_leaks),
    ("private data", private_data),
    ("token ids", token_ids),
]

#: Robust covariance, a trained model and BPE can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            folder = new_folder(spark, f"stage{k}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
