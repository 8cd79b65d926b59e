"""Shared pieces of the training-data operators: input shaping, shared scratch tables, distributed running totals."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import BATCH_BYTES, bound_batches, scratch  # noqa: F401  BATCH_BYTES for callers

#: A word of the operators that count or shingle words: a run of anything but space and the five ASCII controls.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest side, in bytes as counted from its rows, that an operator here broadcasts by hint. Beyond it Spark joins by shuffle.
BROADCAST_BYTES = 8 << 20
ENTRY_BYTES = 48

#: Folders that materialize has written and nothing has removed.
_written: list[str] = []


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes scratch tables; they must not be read any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _written:
            _written.remove(path)


def materialize_only(make, spark: SparkSession, label: str) -> tuple[DataFrame, str]:
    """The table that make() declares, written, and its folder; scratch tables that make wrote on the way are removed."""
    before = set(_written)
    out = materialize(make(), label)
    path = _written[-1]
    remove(spark, [p for p in _written if p not in before and p != path])
    return out, path


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside."""
    bound_batches(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, rows: int = 2000) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and returns its scan.

    It cuts the lineage in a way that outlives lost executors, makes values such as row numbers final, and gives the planner a
    true size, from which it picks broadcast or shuffle joins. The table stays until ``remove`` or until the folder is emptied.
    rows: of an Arrow batch on the way, at most.
    """
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession, rows):
        df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each write inside as it ends, and not at some later time; only written tables are read again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    if before is not None:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(key, before)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table is small enough to be sent to every executor. Counts no more rows than the limit allows.

    row_bytes: of a row's values; its place in a hash table takes about ENTRY_BYTES more.
    """
    most = limit // (row_bytes + ENTRY_BYTES)
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its size, which is counted, permits one."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes) else df


def running_base(totals: DataFrame, order: str, value: str, out: str, by: list[str] | None = None, fan: int = 4096) -> DataFrame:
    """Adds to totals the sum of value over the rows before, ordered by the integer column order, within by.

    Two levels: blocks of fan consecutive orders are summed first, so no window sees more than fan rows, or one row per block.
    """
    by = by or []
    blocks = totals.withColumn("_block", F.floor(F.col(order) / fan))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        blocks.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
        .select(*by, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_head"))
    )
    within = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.join(heads, [*by, "_block"])
        .withColumn(out, F.col("_head") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_block", "_head")
    )


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


WHOLE = ("tinyint", "smallint", "int", "bigint")


def numbered_ids(docs: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(docs with doc_id a bigint in the order of doc_ids, null for null; the table _place, _id of these numbers), for doc_ids that aren't whole numbers."""
    (own,) = fresh(docs, "_own")
    ids = docs.select(F.col("doc_id").alias("_id")).filter(F.col("_id").isNotNull()).distinct().orderBy("_id")
    ids = materialize(ids.select(F.monotonically_increasing_id().alias("_place"), "_id"), label)
    rows = docs.withColumnRenamed("doc_id", own).join(ids, F.col(own) == F.col("_id"), "left")
    return rows.withColumn("doc_id", F.col("_place")).drop("_place", "_id", own), ids


def named_ids(rows: DataFrame, ids: DataFrame, *names: str) -> DataFrame:
    """rows with the numbers of ``numbered_ids`` in columns names replaced by the doc_ids they stand for."""
    order = rows.columns
    for name in names:
        rows = rows.join(ids.select(F.col("_place").alias(name), F.col("_id").alias("_named")), name, "left").drop(name).withColumnRenamed("_named", name)
    return rows.select(*order)
