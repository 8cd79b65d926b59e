"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHOLE, text_or_empty

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS


def ident(df: DataFrame, *others: DataFrame) -> Column:
    """doc_ids to join by: numbers where all the tables' are, else text."""
    whole = all(dict(x.dtypes)["doc_id"] in WHOLE for x in (df, *others))
    return F.col("doc_id").cast("bigint" if whole else "string")


def sample(docs: DataFrame, labels: DataFrame, column: str, bound: int, kind: str | None = None) -> DataFrame:
    """text, y (0 or 1), fold of up to about bound rows of docs with a label outside fold 0, and weight: rows of its class for each sampled one.

    kind: a column of docs that is returned as kind, null if docs hasn't got it.

    Half the bound is for each class; a class with more labels is thinned by a hash of the doc_id. A doc_id with several labels has
    their rounded mean; rows without doc_id or label are left out. doc_ids are of any type; a number is the text of its digits. The sample is small enough to be sent to every executor, as its
    size is bounded, and so selects the documents in one pass.
    """
    key = ident(docs, labels)
    known = labels.filter(key.isNotNull() & F.col(column).isNotNull()).groupBy(key.alias("_id")).agg(F.round(F.avg(F.col(column).cast("double"))).cast("int").alias("y"))
    known = known.filter((fold(F.col("_id")) != 0) & F.col("y").isin(0, 1))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = {y: min(1.0, bound / 2 / n) for y, n in sizes.items()}
    draw = F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("y") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    chosen = known.filter(draw < rate).select("_id", "y", (1 / rate).alias("weight"))
    extra = [] if kind is None else [(F.col(kind) if kind in docs.columns else F.lit(None)).cast("string").alias("kind")]
    rows = docs.select(key.alias("_id"), text_or_empty().alias("text"), *extra)
    return rows.join(F.broadcast(chosen), "_id").select("text", "y", fold(F.col("_id")).alias("fold"), "weight", *(["kind"] if extra else []))
