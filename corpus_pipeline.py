"""Corpus pipeline: filter, deduplicate, decontaminate and tokenize ``documents``.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all
but the last return the columns of ``docs`` as they came. ``run`` writes each stage's
result as parquet and reads it again as the next one's input. Nulls, empty and long texts,
repeated rows, empty tables and clashing column names are treated as each operator's
docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.llm import bpe, decontam, langid, neardup, quality
from milepost.session import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches (6)."""
    return langid.keep_known(docs, langid.model_of(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs (8)."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (10)."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window (4)."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded bytes (2)."""
    vocabulary = bpe.default_vocabulary()
    decoded = bpe.decode(bpe.encode(docs, vocabulary), vocabulary, keep_ids=True)
    return decoded.select("doc_id", "n_tokens", "ids_sha256",
                          F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("language_id", language_id), ("quality_rules", quality_rules),
          ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("tokenize", tokenize)]

# Models, hashing and tokenizing are not SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
