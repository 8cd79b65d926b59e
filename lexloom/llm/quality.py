"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal equations, isotonic calibration.

Statistics of a text (see STATISTICS) are standardised; cos(W x + b) with Gaussian W approximates a Gaussian kernel on them. Each
partition sums Z'Z and Z'y of its rows; the sums of the partitions give the ridge weights. Ridge is fitted on folds 2 to 4, and on
fold 1 pool-adjacent-violators turns its raw scores into probabilities, read off by linear interpolation between the pools' centres.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels, materialize
from .labelled import fold, sample

#: Labelled rows that are used at most.
TRAIN_ROWS = 100_000
FEATURES = 256
RIDGE = 1e-3
THRESHOLD = 0.3
SEED = 4_111

STATISTICS = (
    "log bytes", "log words", "bytes a word", "distinct words", "capitals among letters", "digits", "exclamation marks", "bars", "symbols", "stops",
    "commas", "other punctuation", "line ends", "distinct lines", "bytes above ASCII", "most frequent word", "short words", "words with capitals only",
)
_symbols = np.frombuffer(b"#$%&*@^~+=<>_\\{}[]", np.uint8)
_others = np.frombuffer(b"\"'()-/:;?`", np.uint8)


def statistics(text: bytes) -> np.ndarray:
    """The statistics of a whole text; all finite, also for an empty one."""
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, k = len(text), max(1, len(words))
    upper, lower = count[65:91].sum(), count[97:123].sum()
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.array([
        np.log1p(n), np.log1p(len(words)), min(n / k, 100.0), len(seen) / k, upper / max(1, upper + lower), count[48:58].sum() / k, count[33] / k, count[124] / k,
        count[_symbols].sum() / k, count[46] / k, count[44] / k, count[_others].sum() / k, count[10] / k, len(set(lines)) / max(1, len(lines)), count[128:].sum() / max(1, n),
        max(seen.values(), default=0) / k, (lengths <= 3).mean() if len(lengths) else 0.0, sum(c for w, c in seen.items() if len(w) > 1 and w.isupper()) / k,
    ])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; a thousandth of the raw score keeps the order within a pool."""
        raw = self.raw(x)
        return 0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip(raw, 0, 1)


_rng = np.random.default_rng(SEED)
_W = _rng.normal(size=(len(STATISTICS), FEATURES - 1)) / np.sqrt(len(STATISTICS))
_B = _rng.uniform(0, 2 * np.pi, FEATURES - 1)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant. Standardised statistics beyond 8 deviations count as 8."""
    z = np.sqrt(2 / FEATURES) * np.cos(np.clip(x, -8, 8) @ _W + _B)
    return np.hstack([z, np.ones((len(x), 1))])


def pool_adjacent(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to mean with the given weights."""
    pools: list[list[float]] = []
    for w, m in zip(weight.tolist(), mean.tolist(), strict=True):
        pools.append([w, m, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            b, a = pools.pop(), pools.pop()
            pools.append([a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2] + b[2]])
    return np.concatenate([np.full(int(k), m) for _, m, k in pools]) if pools else np.zeros(0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def fit(docs: DataFrame, label_rows: DataFrame, column: str = "quality", bound: int = TRAIN_ROWS) -> Model:
    """Learns from labelled rows outside fold 0. Without labels of both classes the score is their mean, or 0.5."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                x = [statistics(t) for t in some.column(0).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(x)), len(STATISTICS)).cast(pa.list_(pa.float64())), *(some.column(k) for k in (1, 2, 3))], ["x", "y", "fold", "weight"])

    table = materialize(sample(docs, label_rows, column, bound).mapInArrow(measure, "x array<double>, y int, fold bigint, weight double"), "quality-train")
    head = table.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).first()
    spread = {r["pos"]: r for r in table.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("mean"), F.stddev_pop("col").alias("scale")).collect()}
    size = len(STATISTICS)
    mean = np.array([spread[i]["mean"] if spread else 0.0 for i in range(size)])
    scale = np.array([max(spread[i]["scale"] or 0.0, 1e-6) if spread else 1.0 for i in range(size)])
    flat = Model(mean, scale, np.zeros(FEATURES), np.zeros(1), np.full(1, head["y"] if head["n"] else 0.5))
    if not head["n"] or head["y"] in (0.0, 1.0):
        return flat

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, FEATURES + 1))
        for batch in batches:
            z = fourier((_matrix(batch.column("x")) - mean) / scale)
            weighted = z * batch.column("weight").to_numpy()[:, None]
            total += np.hstack([weighted.T @ z, (weighted.T @ batch.column("y").to_numpy())[:, None]])
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(8), pa.int32()), "sums": pa.array([x.tobytes() for x in np.split(total, 8)], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "sums": [np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0).tobytes()]})

    sums = table.filter("fold <> 1").mapInArrow(normal, "block int, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary").collect()
    if not sums:
        return flat
    total = np.concatenate([np.frombuffer(r["sums"]) for r in sorted(sums, key=lambda r: r["block"])]).reshape(FEATURES, FEATURES + 1)
    a = total[:, :-1]
    weights = np.linalg.solve(a + RIDGE * max(1.0, np.trace(a) / FEATURES) * np.eye(FEATURES), total[:, -1])
    model = Model(mean, scale, weights, flat.knots, flat.values)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(raw, -1, 2) * 500).astype(np.int64)), pa.array(raw), batch.column("y"), batch.column("weight")], ["bin", "raw", "y", "weight"])

    bins = table.filter("fold = 1").mapInArrow(binned, "bin bigint, raw double, y int, weight double").groupBy("bin").agg(F.sum("weight").alias("w"), (F.sum(F.col("raw") * F.col("weight")) / F.sum("weight")).alias("raw"), (F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("mean"))
    rows = sorted(bins.collect(), key=lambda r: r["bin"])  # at most 1501
    if rows:
        weight, raw = np.array([r["w"] for r in rows]), np.array([r["raw"] for r in rows])
        steps = pool_adjacent(weight, np.array([r["mean"] for r in rows]))
        pools = [np.flatnonzero(steps == v) for v in np.unique(steps)]
        model.knots = np.array([np.average(raw[p], weights=weight[p]) for p in pools])
        model.values = np.array([steps[p[0]] for p in pools])
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scorer(model: Model):
    """A column function: the quality score of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [model.score(np.stack([statistics(t) for t in texts.iloc[i : i + 512]])) for i in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    def column(text: Column) -> Column:
        return score(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))

    return column


def quality_scores(docs: DataFrame, label_rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text; other columns are ignored).

    Scores depend on the text alone (null: empty), so equal texts score alike. held_out is false for null doc_ids. An empty table
    gives an empty result.
    """
    score = scorer(fit(docs, label_rows))
    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, label_rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches threshold; all columns stay."""
    return docs.filter(scorer(fit(docs, label_rows))(F.col("text")) >= threshold)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: quality scores of all documents."""
    return quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))
