"""Vectors of the embeddings table as whole numbers: which rows take part, how components become integers, Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def usable(name: str = "embedding") -> Column:
    """Whether a vector is there and all its components are there and finite."""
    inf = float("inf")
    fine = F.forall(F.col(name).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.col(name).isNotNull() & fine


def whole(name: str, scale: int) -> Column:
    """floor(scale * x) of each component, as array<bigint>."""
    return F.transform(F.col(name).cast("array<double>"), lambda x: F.floor(x * float(scale)).cast("bigint"))


def measured(rows: DataFrame, name: str, scale: int) -> tuple[int, int, float]:
    """Rows, the most components of a vector, and the largest scaled magnitude of one, rounded up."""
    largest = F.array_max(F.transform(F.col(name).cast("array<double>"), lambda x: F.abs(x) * float(scale)))
    n, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size(name)), F.max(largest)).first()
    return n, width or 0, (most or 0.0) + 1.0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of width int64 components; shorter lists are filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32) if values.shape[1] else np.zeros(len(values) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1), kind))
