"""The corpus pipeline: quality, exact copies, near copies, mixture, packing. Counted as part of lexloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
The first four return the columns of documents, the last one the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import common, exact_dedup, minhash, mixing, packing, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_quality(docs, common.labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens that hold the sources in the proportions of the mixture."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixture", mix_sources),
    ("packing", pack_windows),
]

#: Classifier scores, link search and tokens are beyond SQL; tests/llm/test_pipeline.py follows the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again; what a stage leaves there goes once the next is written."""
    docs, last = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, path = common.materialize_only(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, f"stage-{name.replace(' ', '-')}")
        common.remove(spark, [last] if last else [])
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
