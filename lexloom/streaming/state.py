"""Streams with state that expires, and the counts that a stream reports batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators.corpus import PASSED, with_reason

#: The state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that keys are hashed to; each holds its keys' state as one value. It is part of a checkpoint's state.
BUCKETS = 64
_HELD = pa.schema([("key", pa.string()), ("at", pa.int64())])


class _Sightings(StatefulProcessor):
    """Keeps the last event times of a bucket's keys, each until nothing that comes can still lie within expiry of it.

    A call of a processor costs far more than a row, so keys share calls: a bucket's rows are judged together.
    """

    def __init__(self, time: str, expiry: int, columns: list[str]) -> None:
        self.time, self.expiry, self.columns = time, expiry, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("held", BinaryType())]))

    def _held(self) -> pd.Series:
        if not self.last.exists():
            return pd.Series([], index=pd.Index([], dtype=object), dtype="int64")
        held = pa.ipc.open_stream(bytes(self.last.get()[0])).read_all()
        return pd.Series(held["at"].to_numpy(), index=pd.Index(held["key"].to_pylist(), dtype=object))

    def _keep(self, held: pd.Series, now: int) -> None:
        """Forgets the keys that the watermark (now, in ms) has left behind; a timer stands for the next that it will."""
        ends = (held + self.expiry) // 1000 + 1
        held, ends = held[ends > now], ends[ends > now]
        if held.empty:
            self.last.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD) as out:
            out.write_table(pa.table([pa.array(held.index, pa.string()), pa.array(held.to_numpy(), pa.int64())], schema=_HELD))
        self.last.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(ends.min()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = pd.concat(list(rows), ignore_index=True).sort_values(["sighting_key", self.time], kind="stable", ignore_index=True)
        at, keys = every[self.time].astype("datetime64[us]").astype("int64"), every["sighting_key"]
        held = self._held()
        first, latest = keys != keys.shift(), keys != keys.shift(-1)
        before = at.shift().where(~first).astype("Int64")  # whole numbers: a double can't tell all microseconds
        before[first] = held.reindex(keys[first]).astype("Int64").to_numpy() if len(held) else pd.NA
        fresh = before.isna() | (at - before > self.expiry).fillna(True).astype(bool)
        seen = pd.Series(at[latest].to_numpy(), index=pd.Index(keys[latest], dtype=object))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        both = pd.concat([held, seen])
        self._keep(both.groupby(level=0, sort=False).max() if len(held) else seen, timerValues.getCurrentWatermarkInMs())
        yield every.loc[fresh.to_numpy(dtype=bool), self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._keep(self._held(), timerValues.getCurrentWatermarkInMs())
        return iter([])

    def close(self) -> None:
        pass


def _one_key(df: DataFrame, keys: list[str]) -> Column:
    """Keys (of atomic types) as one string, equal where all of them are: each with its length before it."""
    strings = [F.hex(k) if t == "binary" else F.col(k).cast("string") for k, t in df.select(*keys).dtypes]
    return F.concat(*[F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in strings])


def first_seen_expiring(stream: DataFrame, keys: list[str], time: str, expiry_seconds: int, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Rows whose keys haven't been seen within expiry_seconds of event time before; any sighting counts, also of a row that goes.

    State holds one number per key, in as many values as there are buckets, and timers clear a key once the watermark (delay behind the
    latest event) is past its expiry, so state is as large as what was seen in that time. Rows are judged in the order of their event
    times within a batch. The session's state store must be RocksDB (``STORE``). A task holds a bucket's rows of a batch at a time.
    """
    key = _one_key(stream, keys)  # names that begin with _ are lost on the way to Python
    marked = stream.withWatermark(time, delay).withColumn("sighting_key", key).withColumn("sighting_bucket", F.pmod(F.xxhash64("sighting_key"), F.lit(buckets)).cast("int"))
    return marked.groupBy("sighting_bucket").transformWithStateInPandas(_Sightings(time, expiry_seconds * 1_000_000, stream.columns), stream.schema, "Append", "EventTime")


def revisits(df: DataFrame, keys: list[str], time: str, expiry_seconds: int) -> DataFrame:
    """The batch form of ``first_seen_expiring``: rows that come more than expiry_seconds after their key's last one, or first."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return df.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") > expiry_seconds * 1_000_000)).drop("_gap")


class Deltas(StreamingQueryListener):
    """Collects what a stream's observation counts in each batch: the change since the last report, as workers' messages would be.

    What the driver holds is one row of counts per batch.
    """

    def __init__(self, name: str) -> None:
        self.name, self.batches = name, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.batches[event.progress.batchId] = found.asDict()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def totals(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for counts in self.batches.values():
            for k, v in counts.items():
                out[k] = out.get(k, 0) + v
        return out


def reporting(stream: DataFrame, rules: list[tuple[str, Column]], name: str = "reasons") -> DataFrame:
    """The rows of a stream that no rule rejects; how many each rule rejects is observed under name, in the same pass."""
    marked = with_reason(stream, rules, "_reason")
    counts = [F.count_if(F.col("_reason") == r).alias(r) for r in dict.fromkeys([*(n for n, _ in rules), PASSED])]
    return marked.observe(name, F.count(F.lit(1)).alias("scanned"), *counts).filter(F.col("_reason") == PASSED).drop("_reason")


def run_reporting(spark: SparkSession, stream: DataFrame, rules: list[tuple[str, Column]], path: str, checkpoint: str, name: str = "reasons") -> Deltas:
    """Writes the rows that pass to path until the input's end, and returns each batch's counts."""
    deltas = Deltas(name)
    spark.streams.addListener(deltas)
    try:
        query: StreamingQuery = reporting(stream, rules, name).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(deltas)
    return deltas
