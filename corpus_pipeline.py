"""A corpus pipeline: toxic documents go, then copies, then near copies; the rest is mixed and packed.

Every stage reads what its predecessor kept, as a table. All but the last return the columns of
documents; the last returns the packed pieces of the documents that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablecheck.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from tablecheck.llm.common import read_table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # five words and 0.8, as is usual for near copies; op6's contract has three and 0.9
    return jaccard_join.one_per_component(docs, size=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# a trained network decides what the first stage keeps, so SQL cannot state the rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
