"""Mixing sources to target weights: repetition rates from token totals, whole repeats plus one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, fresh, materialize, running_base, small, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20_240
#: Rows of one partition that are numbered together.
BLOCK = 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target for each source of sizes (source, size).

    Sources, by code point with null last, weigh ``weights`` in turn and share ``share`` times all words. A target stops at ``most``
    times its source's size, and what is over is shared again by weight until no target is above. That end is a water level: with the
    sources in order of cap per weight, it is the first level at which the next source isn't filled. Windows here run over one row
    per source.
    """
    every = Window.partitionBy()
    ordered = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("place", F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last())))
        .withColumn("total", F.sum("source_size").over(every))
    )
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    level = ordered.withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("free", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = level.withColumn("level", (F.col("total") * float(share) - F.col("filled")) / F.col("free"))
    level = level.withColumn("water", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(every))
    return level.select("source", "source_size", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), "cap").alias("target"))


def draw(doc_id: Column, digest: Column, turn: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on a row's doc_id, its text's MD5, its turn among equal rows, and the seed: 52 bits of an MD5 digest."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), digest, turn.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_turn(rows: DataFrame, digest: str, turn: str) -> DataFrame:
    """rows (doc_id, source, digest, …) with turn: 1, 2, … among the rows of equal doc_id, source and digest.

    Only rows whose doc_id repeats are numbered: within blocks of a partition, and from the counts of the blocks before. So no window
    sees more than BLOCK rows, or a row per 4096 blocks, however many rows are equal. Equal rows may swap their turns on a rerun.
    """
    id_, block_, base_, n_ = fresh(rows, "_again", "_chunk", "_base", "_n")
    again = materialize(rows.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(id_)), "mix-again")
    if again.isEmpty():
        return rows.withColumn(turn, F.lit(1).cast("bigint"))
    found = rows.join(small(again.withColumn(n_, F.lit(1)), 24), F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    once = found.filter(F.col(n_).isNull()).drop(id_, n_).withColumn(turn, F.lit(1).cast("bigint"))
    many = materialize(found.filter(F.col(n_).isNotNull()).drop(id_, n_).withColumn(block_, F.floor(F.monotonically_increasing_id() / BLOCK)), "mix-many")
    # The key is a digest, as null doc_ids and sources count as equal.
    key = F.md5(F.concat_ws(":", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("doc_id", "source", digest)]).cast("binary"))
    many = many.withColumn(id_, key)
    counts = many.groupBy(id_, block_).agg(F.count(F.lit(1)).alias(n_))
    bases = materialize(running_base(counts, block_, n_, base_, [id_]).select(id_, block_, base_), "mix-bases")
    within = F.row_number().over(Window.partitionBy(id_, block_).orderBy(F.lit(1)))
    return once.unionByName(many.withColumn(turn, within).join(bases, [id_, block_]).withColumn(turn, F.col(turn) + F.col(base_)).drop(id_, block_, base_))


def _copies(rate: Column, chance: Column) -> Column:
    return F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of docs (doc_id, text, source; other columns are ignored).

    size counts the words of the whole text (null: 0). A source's rate is target over size; each document is taken floor(rate) times,
    and once more if its seeded draw is below the fraction. Null sources are one source. Rows that repeat a doc_id, or have none, draw
    each for itself. Sources without words, and an empty table, have rate 0 and target 0.
    """
    sizes = materialize(docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), F.md5(text_or_empty().cast("binary")).alias("digest")), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, share, most).select(F.col("source").alias("_source"), "source_size", "target"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        with_turn(sizes, "digest", "turn").join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("copies", _copies(rate, draw(F.col("doc_id"), F.col("digest"), F.col("turn"), seed)))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mixture takes it; all columns stay. The rates are joined to docs by source."""
    source, rate, copy, digest, turn = fresh(docs, "_source", "_rate", "_copy", "_digest", "_turn")
    sizes = docs.select("source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))
    rates = source_targets(sizes, weights, share, most).select(F.col("source").alias(source), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate))
    rates = materialize(rates, "mix-rates")
    joined = with_turn(docs.withColumn(digest, F.md5(text_or_empty().cast("binary"))), digest, turn).join(rates, F.col("source").eqNullSafe(F.col(source)))
    copies = _copies(F.col(rate), draw(F.col("doc_id"), F.col(digest), F.col(turn), seed)).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: what the mixture takes of all documents."""
    return mixture(documents(spark, sf_dir))


#: DuckDB reads the same rules; the draw and the water level are computed with the same double operations.
MIX_SQL = r"""
sized AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest) AS turn FROM
          (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM {docs})),
ranked AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rn - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
placed AS (SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS place, sum(source_size) OVER ()::DOUBLE AS total FROM weighed),
levels AS (SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
           FROM placed WINDOW b AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, place) AS water FROM levels WHERE level <= ratio),
targets AS (SELECT source, source_size, coalesce(least(cap, water * weight), cap) AS target,
                   CASE WHEN source_size > 0 THEN coalesce(least(cap, water * weight), cap) / source_size ELSE 0.0::DOUBLE END AS rate FROM levels, water),
taken AS (SELECT s.*, source_size, target,
                 (floor(rate) + CASE WHEN ('0x' || substr(md5('20240:' || coalesce(doc_id::VARCHAR, '') || ':' || digest || ':' || turn), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
          FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)"""

OP4_SQL = "WITH " + MIX_SQL.format(docs="documents") + "\nSELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM taken"
