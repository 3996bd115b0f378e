"""A training corpus out of documents: toxicity filter, exact and near dedup, personal data, packing.

Each stage takes null and empty texts (they are never toxic or near copies; as exact copies of each other one stays), rows with a null identifier (the dedup stages keep them),
repeated identifiers, empty tables and further columns, which all but the last stage return as they are. Ties go to the smaller identifier. The stages'
operators say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import exact_dedup, near_dedup, packing, pii, toxicity
from shelfmark.runtime import Scratch, cleared


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 by a classifier learned from `labels`."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest, then that with the smallest identifier."""
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.kept_rows(docs, percent=80)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of personal data."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("personal data", mask_private), ("packing", pack)]

#: Learned models and tokenizers are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with cleared():  # what a stage wrote on its way
            docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
