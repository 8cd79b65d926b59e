"""Toxicity by a classifier chain: linear models predict categories one after the other, each fed the probabilities before it.

The categories are toxicity in each of the languages with most toxic training rows (LANGUAGES at most), by the rows' ``lang``, and last
``toxic`` as labelled, whose probability is the score. A later model is trained on out-of-fold predictions of the earlier ones, so it sees
them as uncertain as they will be on new texts; terms, too, are chosen anew outside each fold for these predictions. The language of a
document is a target in training and never an input.

Features are the presence of terms: words in lower case, and beginnings of 3 to 6 bytes that inflected or invented words share. Terms
are chosen from their document counts among toxic and other training rows; logistic models on them are fitted by Newton's method.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels, materialize
from .labelled import fold, sample

#: Labelled rows that are used at most, terms kept, and toxic training rows that a term needs.
TRAIN_ROWS = 16_000
TERMS = 256
LEAST = 5
BEGINNINGS = (3, 4, 5, 6)
RIDGE = 0.5
THRESHOLD = 0.5
#: Categories before the last.
LANGUAGES = 3
STRIP = b".,;:!?$&%*#|'\"()[]<>-_"


def terms(text: bytes) -> set[bytes]:
    """The words of a whole text, and their beginnings with a tilde."""
    words = {w.strip(STRIP) for w in set(text.lower().split())}
    words.discard(b"")
    return words.union(*({w[:k] + b"~" for w in words if len(w) > k} for k in BEGINNINGS))


@dataclass
class Model:
    """weights: a vector for each category of the chain, over terms, earlier probabilities, and a constant."""

    index: dict[bytes, int]
    weights: list[np.ndarray]
    categories: list[str] = field(default_factory=lambda: ["toxic"])

    def hits(self, text: bytes) -> list[int]:
        index, found = self.index, set()
        for w in set(text.lower().split()):
            w = w.strip(STRIP)
            if w[:3] in self.starts:
                found.add(index.get(w))
                for k in BEGINNINGS:
                    if len(w) > k:
                        found.add(index.get(w[:k] + b"~"))
        found.discard(None)
        return sorted(found)

    def __post_init__(self):
        self.starts = {t.removesuffix(b"~")[:3] for t in self.index}

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.index)))
        for i, hits in enumerate(rows):
            x[i, hits] = 1.0
        out = np.zeros((len(rows), len(self.weights)))
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(np.hstack([x, _logit(out[:, :k]), np.ones((len(x), 1))]) @ w)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Weights of a ridge-penalised logistic model; the last column of x is a constant and isn't penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w


def chain(hits: np.ndarray, targets: np.ndarray, weight: np.ndarray, folds: np.ndarray, whole: list[int], without: dict[int, list[int]]) -> list[np.ndarray]:
    """The weights of each category's model. hits: rows by terms; whole: the terms to use; without: those to use where a fold is left out.

    Equal rows may be one row with their weights summed.
    """
    rows = lambda terms, inside: np.hstack([hits[np.ix_(inside, terms)].astype(float), _logit(earlier[inside]), np.ones((len(inside), 1))])
    weights, earlier, every = [], np.zeros((len(hits), 0)), np.arange(len(hits))
    for y in targets.T:
        weights.append(logistic(rows(whole, every), y, weight))
        out = np.zeros(len(hits))
        for f, terms in without.items():
            inside, outside = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
            out[inside] = _sigmoid(rows(terms, inside) @ logistic(rows(terms, outside), y[outside], weight[outside])) if len(outside) else y.mean()
        earlier = np.hstack([earlier, out[:, None]])
    return weights


def fit(docs: DataFrame, label_rows: DataFrame, column: str = "toxic", bound: int = TRAIN_ROWS, most: int = TERMS) -> Model:
    """Learns from labelled rows outside fold 0, each text once. Without labels of both classes nothing counts as toxic.

    docs without a column lang have the last category only.
    """
    one = F.max(F.struct("y", "fold", "weight", "kind")).alias("r")
    train = materialize(sample(docs, label_rows, column, bound, "lang").groupBy("text").agg(one).select("text", "r.*"), "toxic-train")
    sizes = {(r["y"], r["fold"]): r["count"] for r in train.groupBy("y", "fold").count().collect()}
    total = lambda y, but=None: sum(n for (c, f), n in sizes.items() if c == y and f != but)
    if not total(0) or not total(1):
        return Model({}, [np.array([-30.0])])
    folds = sorted({f for _, f in sizes})
    kinds = [r["kind"] for r in train.filter("y = 1 AND kind IS NOT NULL").groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(LANGUAGES).collect()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[Counter, Counter]] = {f: (Counter(), Counter()) for f in folds}
        for batch in batches:
            for text, y, f in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen[f][y].update(terms(text))
        for f, (other, toxic) in seen.items():
            names = list(other.keys() | toxic.keys())
            for i in range(0, len(names), 50_000):
                some = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([f] * len(some), pa.int64()), pa.array([toxic[t] for t in some], pa.int64()), pa.array([other[t] for t in some], pa.int64())], ["term", "fold", "toxic", "other"])

    counted = train.select("text", "y", "fold").mapInArrow(count, "term binary, fold bigint, toxic bigint, other bigint")
    sums = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in folds for c in ("toxic", "other")]
    counts = materialize(counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), *sums).filter(F.col("toxic") >= LEAST), "toxic-terms")

    def best(but: int | None) -> DataFrame:
        """The best terms by the rows outside a fold."""
        toxic, other = (F.col(c) - (F.col(f"{c}{but}") if but is not None else 0) for c in ("toxic", "other"))
        n, m = max(1, total(1, but)), max(1, total(0, but))
        p, q = toxic / float(n), other / float(m)
        z = (p - q) / F.sqrt(p * (1 - p) / n + q * (1 - q) / m + 1e-9)
        return counts.filter((toxic >= LEAST) & (p > 4 * q)).orderBy(z.desc(), "term").limit(most).select("term", F.lit(-1 if but is None else but).alias("but"))

    chosen = reduce(DataFrame.unionByName, [best(f) for f in (None, *folds)]).collect()
    whole = [bytes(r["term"]) for r in chosen if r["but"] == -1]
    index = {t: i for i, t in enumerate(dict.fromkeys([*whole, *(bytes(r["term"]) for r in chosen)]))}
    seen = Model(index, [])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [seen.hits(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *(batch.column(k) for k in (1, 2, 3, 4))], ["hits", "y", "fold", "weight", "kind"])

    looked = train.select("text", "y", "fold", "weight", F.when(F.col("kind").isin(kinds), F.col("kind")).alias("kind")).mapInArrow(look, "hits array<int>, y int, fold bigint, weight double, kind string")
    rows = looked.groupBy("hits", "y", "fold", "kind").agg(F.sum("weight").alias("weight")).collect()  # at most TRAIN_ROWS
    hits = np.zeros((len(rows), len(index)), bool)
    for i, r in enumerate(rows):
        hits[i, r["hits"]] = True
    y = np.array([r["y"] for r in rows], float)
    targets = np.stack([*[y * [r["kind"] == k for r in rows] for k in kinds], y], axis=1)
    without = {f: [index[bytes(r["term"])] for r in chosen if r["but"] == f] for f in folds}
    weights = chain(hits, targets, np.array([r["weight"] for r in rows]), np.array([r["fold"] for r in rows]), [index[t] for t in whole], without)
    return Model({t: i for i, t in enumerate(whole)}, weights, [*(f"toxic_{k}" for k in kinds), "toxic"])


def toxicity(docs: DataFrame, label_rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (of the last category), predicted, chain for each row of docs (doc_id, text, lang; others are ignored).

    chain: array<double>, the probabilities of all categories in turn. Scores depend on the text alone (null: empty); equal texts
    score alike. held_out is false for null doc_ids. A doc_id that isn't a number has no label. An empty table gives an empty result.
    """
    model = fit(docs, label_rows)

    @F.pandas_udf("array<double>")
    def probabilities(texts: pd.Series) -> pd.Series:
        out = [x for i in range(0, len(texts), 1024) for x in model.probabilities([model.hits(t) for t in texts.iloc[i : i + 1024]])]
        return pd.Series(out, dtype=object)

    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), probabilities(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("chain"))
    score = F.element_at("chain", -1)
    return rows.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "chain")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the chain's score for all documents."""
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
