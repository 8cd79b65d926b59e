"""Deterministic samples and splits: order is a digest of key and seed, so reruns and other engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled_by(*keys: str, seed: int = 42) -> Column:
    """A digest to order by; md5 of the keys, joined by bars, and the seed."""
    return F.md5(F.concat(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), F.lit(str(seed))).cast("binary"))


def head_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(shuffled_by(key, seed=seed), key).limit(n)


def ranked(df: DataFrame, by: list[str], key: str, seed: int = 42, out: str = "_n") -> DataFrame:
    """df with each row's number in digest order within by, from 1.

    The digest's first digits cut a group into buckets, whose counts say where their numbers begin; a window numbers the rows of one
    bucket only. So a group may hold any share of all rows, or be the whole table. Null groups are a group.
    """
    names = [f"_by{i}" for i in range(len(by))] + [f"_null{i}" for i in range(len(by))]
    told = {f"_by{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(by)} | {f"_null{i}": F.col(c).isNull() for i, c in enumerate(by)}
    digest = shuffled_by(key, seed=seed)
    rows = df.withColumns(told | {"_digest": digest, "_bucket": F.substring(digest, 1, 4)})
    sizes = rows.groupBy(*names, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.select(*names, "_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_head"))
    # Join and window have the same keys, so rows move once.
    within = Window.partitionBy(*names, "_bucket").orderBy("_digest", key)
    return rows.join(heads, [*names, "_bucket"]).withColumn(out, F.col("_head") + F.row_number().over(within)).drop(*names, "_digest", "_bucket", "_head")


def per_group(df: DataFrame, n: int | Column, by: list[str], key: str, seed: int = 42) -> DataFrame:
    return ranked(df, by, key, seed).filter(F.col("_n") <= n).drop("_n")


def stratified(df: DataFrame, score: str, source: str, key: str, per_bin: int = 50, seed: int = 42) -> DataFrame:
    """Up to per_bin rows for each score, dealt to sources in order: each in proportion (rounded half to even), at least one and no more
    than it has while any are left; the last source takes what is left."""
    cells = df.groupBy(score, source).agg(F.count(F.lit(1)).alias("_c"))
    bin_, run = Window.partitionBy(score), Window.partitionBy(score).orderBy(source).rowsBetween(Window.unboundedPreceding, -1)
    shares = cells.withColumn("_t", F.least(F.sum("_c").over(bin_), F.lit(per_bin)))
    shares = shares.withColumn("_k", F.greatest(F.lit(1), F.least(F.col("_c"), F.bround(F.col("_t") * F.col("_c") / F.sum("_c").over(bin_)))).cast("bigint"))
    last = F.row_number().over(bin_.orderBy(F.col(source).desc())) == 1
    left = F.greatest(F.lit(0), F.col("_t") - F.coalesce(F.sum("_k").over(run), F.lit(0)))
    quotas = shares.select(F.col(score).alias("_score"), F.col(source).alias("_source"), F.least(F.when(last, left).otherwise(F.least("_k", left)), F.col("_c")).alias("_q"))
    rows = ranked(df, [score, source], key, seed)
    return rows.join(quotas, F.col(score).eqNullSafe(F.col("_score")) & F.col(source).eqNullSafe(F.col("_source"))).filter("_n <= _q").drop("_n", "_q", "_score", "_source")


def stratified_split(df: DataFrame, by: str, key: str, train: float = 0.95, seed: int = 42, names: tuple[str, str] = ("train", "val")) -> DataFrame:
    """split: per group the first floor(train * n) rows in digest order are names[0], the rest names[1]."""
    sizes = df.groupBy(F.col(by).alias("_group")).agg(F.count(F.lit(1)).alias("_size"))
    rows = ranked(df, [by], key, seed).join(sizes, F.col(by).eqNullSafe(F.col("_group")))
    return rows.withColumn("split", F.when(F.col("_n") <= F.floor(F.col("_size") * train), names[0]).otherwise(names[1])).drop("_n", "_group", "_size")


def group_holdout(df: DataFrame, group: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """group, n, held: whole groups in digest order are held out until they have share of all rows, rounded half to even."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("_digest", shuffled_by(group, seed=seed)).withColumn("_bucket", F.substring("_digest", 1, 4))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.groupBy("_bucket").agg(F.sum("n").alias("_h")).select("_bucket", F.coalesce(F.sum("_h").over(before().orderBy("_bucket")), F.lit(0)).alias("_h"), F.sum("_h").over(Window.partitionBy()).alias("_total"))
    placed = sizes.join(heads, "_bucket").withColumn("_before", F.col("_h") + F.coalesce(F.sum("n").over(before("_bucket").orderBy("_digest", group)), F.lit(0)))
    return placed.select(group, "n", (F.col("_before") < F.bround(F.col("_total") * share)).alias("held"))


def leakage_free_split(df: DataFrame, group: str, key: str, test: float = 0.1, val: float = 0.05, seed: int = 42) -> DataFrame:
    """split: test holds whole groups, so none of its groups is in train or val; val is a uniform sample of the rest, of val of all rows."""
    held = group_holdout(df, group, test, seed).filter("held").select(F.col(group).alias("_group"), F.lit(True).alias("_held"))
    marked = df.join(held, F.col(group).eqNullSafe(F.col("_group")), "left").withColumn("_held", F.coalesce("_held", F.lit(False))).drop("_group")
    size = df.agg(F.bround(F.count(F.lit(1)) * val).alias("_most"))
    rows = ranked(marked, ["_held"], key, seed).join(F.broadcast(size))  # one row
    return rows.withColumn("split", F.when(F.col("_held"), "test").when(F.col("_n") <= F.col("_most"), "val").otherwise("train")).drop("_held", "_n", "_most")


def shared_groups(df: DataFrame, group: str, split: str = "split", a: str = "test", b: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """Groups that leak; empty for a split by whole groups."""
    return df.filter(F.col(split) == a).select(group).intersect(df.filter(F.col(split).isin(*b)).select(group))


def quotas(df: DataFrame, key: str, sizes: list[tuple[str, int]], seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """split: in digest order (within by) the first sizes[0] rows get its name, the next sizes[1] its, and so on; the rest goes."""
    out, upto = F.lit(None).cast("string"), 0
    for name, n in sizes:
        out = F.when((F.col("_n") > upto) & (F.col("_n") <= upto + n), name).otherwise(out)
        upto += n
    return ranked(df, by or [], key, seed).withColumn("split", out).filter("split IS NOT NULL").drop("_n")
