"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

language ID (rejected documents go), n-gram Jaccard join (one document of each
component stays), suffix-array dedup (repeated passages go), source mixing (the
mix's words, repeats as further rows), byte-level BPE (a row of token figures
for each document of the mix).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdex.llm import bpe, jaccard, language, mixing, suffixes
from loomdex.llm import textkit as tk
from loomdex.plans.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.stage(ship(spark), docs, sf_dir)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.stage(ship(spark), docs, sf_dir)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.stage(ship(spark), docs, sf_dir)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.stage(ship(spark), docs, sf_dir)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.stage(ship(spark), docs, sf_dir)


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("suffix_dedup", suffix_dedup), ("source_mixing", source_mixing), ("byte_bpe", byte_bpe)]

#: SQL cannot express suffix arrays, seeded draws or merges; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tk.table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, tk.stored(stage(spark, docs, sf_dir), name)
        tk.discard(before)
    return docs
