"""Exact deduplication: counting quotient filters find the repeated fingerprints, and only their texts are compared byte by byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quotient_filter as qf
from .common import documents, fresh, materialize, small, text_or_empty

#: Documents for each block of the fingerprint space; a block is merged by one task.
DOCS_PER_BLOCK = 1_000_000


def repeated_fingerprints(fingerprints: DataFrame, block_bits: int) -> DataFrame:
    """Column fp (bigint) in, the distinct fp that occur more than once out, with their count n.

    Each partition builds a counting quotient filter for each block of the fingerprint space; the filters of a block are merged.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if got:
            made = qf.blocks(np.concatenate(got), block_bits)
            yield pa.RecordBatch.from_pydict({"block": pa.array([x[0] for x in made], pa.int64()), "filter": pa.array([x[1] for x in made], pa.binary())})

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fp, n = qf.decode(qf.merge(list(pdf["filter"]), int(key[0]), block_bits), int(key[0]), block_bits)
        return pd.DataFrame({"fp": fp[n > 1].view(np.int64), "n": n[n > 1]})

    return fingerprints.select("fp").mapInArrow(build, "block bigint, filter binary").groupBy("block").applyInPandas(merge, "fp bigint, n bigint")


def exact_duplicates(docs: DataFrame, docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """For each row of docs (doc_id, text; other columns are ignored): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. In a group of equal texts the row with the largest doc_id
    stays. Null doc_ids lose against any other; of rows that tie on doc_id, or of a group with no doc_id at all (keep_id null),
    one stays. An empty table gives an empty result.
    """
    # 1. One pass over the texts: fingerprint and digest of each row, and a row number that is final once written.
    rows = materialize(
        docs.select("doc_id", F.xxhash64(text_or_empty()).alias("fp"), F.sha2(F.encode(text_or_empty(), "UTF-8"), 256).alias("sha"), F.monotonically_increasing_id().alias("rid")),
        "dedup-rows",
    )
    block_bits = int(np.clip(np.ceil(np.log2(max(1, rows.count()) / docs_per_block)), 6, 20))
    # 2. The fingerprints with a count above one.
    repeated = materialize(repeated_fingerprints(rows, block_bits), "dedup-repeated")
    few = small(repeated.select("fp"), 16)
    # 3. Byte verification of those: all texts under one fingerprint and digest are the same if the least is the greatest.
    texts = docs.select(text_or_empty().alias("text")).withColumn("fp", F.xxhash64("text")).join(few, "fp", "left_semi").withColumn("sha", F.sha2(F.encode("text", "UTF-8"), 256))
    same = texts.groupBy("fp", "sha").agg((F.min("text") == F.max("text")).alias("same"))
    groups = materialize(
        rows.join(few, "fp", "left_semi").groupBy("fp", "sha").agg(F.max(F.struct("doc_id", "rid")).alias("last"), F.count(F.lit(1)).alias("group_size"))
        .join(same, ["fp", "sha"]).select("fp", "sha", F.col("last.doc_id").alias("keep_id"), F.col("last.rid").alias("keep_rid"), "group_size", "same"),
        "dedup-groups",
    )
    if not groups.filter("NOT same").isEmpty():
        return _by_bytes(docs)
    return (
        rows.join(groups, ["fp", "sha"], "left")
        .select(
            "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).alias("group_size"), (F.coalesce("keep_rid", "rid") == F.col("rid")).alias("kept"), F.col("sha").alias("text_sha256"),
        )
    )


def _by_bytes(docs: DataFrame) -> DataFrame:
    """The same result by comparing all texts; for the day that two texts share both digests."""
    rows = materialize(docs.select("doc_id", text_or_empty().alias("text"), F.monotonically_increasing_id().alias("rid")), "dedup-bytes")
    groups = rows.groupBy("text").agg(F.max(F.struct("doc_id", "rid")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "text").select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("last.rid") == F.col("rid")).alias("kept"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs without those whose text a row with a larger doc_id repeats; all columns stay.

    Of rows that share doc_id and text, one stays. Null texts count as empty; of a group with no doc_id at all, one row stays.
    """
    id_, sha, gone_sha = fresh(docs, "_id", "_sha", "_gone")
    gone = materialize(
        exact_duplicates(docs).groupBy(F.col("doc_id").alias(id_), F.col("text_sha256").alias(gone_sha)).agg(F.count_if(~F.col("kept")).alias("drops"), F.count_if("kept").alias("stays")).filter("drops > 0"),
        "dedup-gone",
    )
    marked = docs.withColumn(sha, F.sha2(F.encode(text_or_empty(), "UTF-8"), 256))
    match = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(sha) == F.col(gone_sha))
    rest = marked.join(small(gone.select(id_, gone_sha), 96), match, "left_anti").drop(sha)
    ties = gone.filter("stays > 0").select(id_, gone_sha)
    if ties.isEmpty():
        return rest
    return rest.unionByName(marked.join(small(ties, 96), match, "left_semi").dropDuplicates(["doc_id", sha]).drop(sha))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: groups of equal texts among all documents."""
    return exact_duplicates(documents(spark, sf_dir))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
