"""The folder that all executors share, for tables that cut lineage; the session's bound on batches for Python."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between the JVM and Python, at most.
BATCH_BYTES = 16 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Where it is unset, a fresh folder, but only if all tasks run in this process."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        conf = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/lexloom"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES, where Spark has one, for this and later stages.

    Documents are large rows, some very large, and each task holds a batch twice, in the JVM and in Python.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", (spark.conf.get(key, None) or "").strip().lower())
    size = int(now[1]) << 10 * " kmgtp".index(now[2] or " ") if now else 0
    if size < 0 or size > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
