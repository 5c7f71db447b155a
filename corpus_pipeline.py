"""From raw documents to packed training sequences, in five written stages.

Each stage works on everything its predecessor kept. All but the last return the
columns of ``documents``.

Defined results, for every stage: a null text counts as empty and stays null; null and
repeated ids are told apart by their texts, and of rows alike in both one stays where
one of a group does; texts of any length are read whole; an empty table
gives an empty result; further columns, whatever their names, pass through all
stages but packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import documents, materialize
from tessera.llm.exact_dedup import keep_one
from tessera.llm.packing import default_tokenizer, pack
from tessera.llm.pii import mask_pii
from tessera.llm.quality import keep_good
from tessera.llm.similar import keep_one_similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the compression bands and the base rules."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that fingerprints of five-word shingles find near and whose shingle sets are 0.8 similar or more."""
    return keep_one_similar(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    return pack(docs, default_tokenizer())


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("simhash near-dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: Fingerprints, compression ratios and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
