"""A training corpus in five stages: quality rules, exact dedup, near-dedup, source mix, packing.

Each stage works on all that its predecessor kept, as a stored table, and returns the columns of
`documents`; the last returns the pieces of documents with their places in training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import exact_dedup, mixing, near_dup, packing, quality_rules
from strata.llm.common import cut, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return quality_rules.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word shingles."""
    return near_dup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_good),
    ("exact dedup", drop_copies),
    ("near-dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Packing counts token ids, which SQL cannot; tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
