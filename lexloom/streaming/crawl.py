"""Structured Streaming forms of the crawl operators: the same column logic, state in Spark's store, progress in its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import with_reason


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 100) -> DataFrame:
    """files: how many a batch takes at most; that is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def first_seen(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose keys are new. With an event time, keys older than delay are forgotten, so state is bounded."""
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def reason_counts(stream: DataFrame, rules: list) -> DataFrame:
    """reason, n: for update or complete mode."""
    return with_reason(stream, rules).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, time: str, by: list[str], size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    frame = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, delay).groupBy(frame.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def collect_until(stream: DataFrame, path: str, checkpoint: str, most: int, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
    """Appends transformed batches to path until most rows are there or the input ends; the rows there. A rerun goes on from the checkpoint.

    The batch that comes when there are enough is refused, so it isn't committed and a rerun begins with it.
    """
    spark = stream.sparkSession

    def there(folder: str) -> int:
        try:
            return spark.read.parquet(folder).count()
        except AnalysisException:
            return 0

    state = {"rows": there(path), "enough": False}

    def write(batch: DataFrame, number: int) -> None:
        state["enough"] = state["rows"] >= most
        if state["enough"]:
            raise RuntimeError("enough rows")
        own = f"{path}/batch={number}"
        before = there(own)  # of a run that stopped before it could commit this batch
        transform(batch).write.mode("overwrite").parquet(own)
        state["rows"] += there(own) - before

    query: StreamingQuery = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not state["enough"]:
            raise
    return state["rows"]
