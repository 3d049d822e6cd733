"""The corpus pipeline: each stage takes what its predecessor kept.

All stages but the last return the columns of documents; the last returns the packed pieces.

Defined results: null texts and blank ones fail the quality rules and go; so do all of fewer than 50 words. Very long
texts pass every stage whole. Of rows with equal texts the largest doc_id stays, of near copies the smallest; rows
without an id stay only if none of their group has one, and of rows that repeat both id and text one stays. Without
labels only the base rules reject. An empty table gives no rows. Other columns are carried to the last stage, of
whatever type they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, packing, quality, simhash, toxicity
from factloom.llm.common import checkpoint, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("best-fit packing", pack),
]

#: Two stages learn from labels, which SQL can't express; tests hold run() against brute force in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        # what a stage kept is written down, as later stages read it several times
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
