"""Nearest anchors in vector space, hits grouped by post, anchor-validity filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Anchors that one block of the matrix product holds; more anchors mean more blocks.
ANCHOR_BLOCK = 4096
#: Rows that meet a block of anchors in a task.
ROW_TILE = 1 << 15


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, clamp: bool = False) -> Column:
    """0 where a norm is 0; clamp: negative ones count as 0."""
    out = F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))
    return F.greatest(out, F.lit(0.0)) if clamp else out


def nearest(rows: DataFrame, anchors: DataFrame, key: str, vector: str, anchor_key: str) -> DataFrame:
    """key, anchor, similarity: the most similar of anchors (anchor_key, vector, unit length) for each row; the least anchor on a tie.

    Native: every row meets every anchor, and a maximum that Spark also takes before its shuffle keeps one. anchors is the query set, of
    at most ANCHOR_BLOCK rows; more go to ``nearest_blocked``.
    """
    if anchors.limit(ANCHOR_BLOCK + 1).count() > ANCHOR_BLOCK:
        return nearest_blocked(rows, anchors, key, vector, anchor_key)
    pairs = rows.select(key, F.col(vector).alias("_v")).join(F.broadcast(anchors.select(F.col(anchor_key).alias("_a"), F.col(vector).alias("_w"))))
    scored = pairs.select(key, "_a", dot(F.col("_v"), F.col("_w")).alias("_s"))
    return _best(scored.select(key, F.col("_a").alias("anchor"), F.col("_s").alias("similarity")), key)


def _best(scored: DataFrame, key: str) -> DataFrame:
    return scored.groupBy(key).agg(F.max(F.struct("similarity", (-F.col("anchor")).alias("_b"))).alias("_m")).select(key, (-F.col("_m._b")).alias("anchor"), F.col("_m.similarity").alias("similarity"))


def nearest_blocked(rows: DataFrame, anchors: DataFrame, key: str, vector: str, anchor_key: str, block: int = ANCHOR_BLOCK, tile: int = ROW_TILE) -> DataFrame:
    """As nearest, by matrix products over Arrow blocks, for any number of anchors: neither side is on the driver or in one task.

    Anchors are dealt to blocks and rows to tiles by hash, and each tile meets each block in a task that holds just these two; the blocks'
    best are compared by an aggregate. Rows travel once for each block of anchors, anchors once for each tile.
    """
    n_rows, n_anchors = rows.count(), anchors.count()
    kind = f"{key} {rows.schema[key].dataType.simpleString()}, anchor bigint, similarity double"
    if not n_anchors or not n_rows:
        return rows.sparkSession.createDataFrame([], kind)
    tiles, blocks = -(-n_rows // tile), -(-n_anchors // block)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.select(F.col(key).alias("_key"), F.col(vector).alias("_v"), F.pmod(F.xxhash64(key), F.lit(tiles)).cast("int").alias("_tile"), every(blocks).alias("_block"))
    right = anchors.select(F.col(anchor_key).cast("bigint").alias("_key"), F.col(vector).alias("_v"), every(tiles).alias("_tile"), F.pmod(F.xxhash64(anchor_key), F.lit(blocks)).cast("int").alias("_block"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([a["_key"].slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], [key, "anchor", "similarity"])
        matrix = lambda t: t["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        ids = b["_key"].to_numpy()
        order = np.argsort(ids, kind="stable")
        m, v = matrix(b)[order], matrix(a)
        who, top = np.empty(len(v), np.int64), np.empty(len(v))
        for i in range(0, len(v), 2048):
            s = v[i : i + 2048] @ m.T
            at = s.argmax(axis=1)
            who[i : i + 2048], top[i : i + 2048] = ids[order][at], s[np.arange(len(s)), at]
        return pa.table([a["_key"], pa.array(who), pa.array(top)], [key, "anchor", "similarity"])

    met = left.groupBy("_tile", "_block").cogroup(right.groupBy("_tile", "_block")).applyInArrow(best, kind)
    return _best(met, key) if blocks > 1 else met


def post_best(rows: DataFrame, anchors: DataFrame, key: str, vector: str, anchor_key: str, post: str, least: float = 0.0) -> DataFrame:
    """post, key, anchor, similarity: of each post's rows the one nearest to any anchor, if it is as near as least; the least key on a tie.

    anchors may be mined from the corpus and so grow with it: distinct matched sentences, embedded (see ``distinct_anchors``).
    """
    near = nearest_blocked(rows, anchors, key, vector, anchor_key).filter(F.col("similarity") >= least)
    own = near.join(rows.select(key, F.col(post)), key)
    top = own.groupBy(post).agg(F.max(F.struct("similarity", (-F.col(key)).alias("_k"), (-F.col("anchor")).alias("_a"))).alias("_m"))
    return top.select(post, (-F.col("_m._k")).alias(key), (-F.col("_m._a")).alias("anchor"), F.col("_m.similarity").alias("similarity"))


def distinct_anchors(matches: DataFrame, sentence: str = "matched_sentence") -> DataFrame:
    """anchor, sentence: a corpus' matched sentences, distinct by digest; anchor is a number made of the digest."""
    digest = F.md5(F.col(sentence).cast("binary"))
    return matches.groupBy(digest.alias("_d")).agg(F.min(sentence).alias("sentence")).select(F.conv(F.substring("_d", 1, 15), 16, 10).cast("bigint").alias("anchor"), "sentence")


def group_hits(hits: DataFrame, post: str, sentence: str, similarity: str, *more: str, least: float = 0.75) -> DataFrame:
    """A row per post with an array of its hits by falling confidence; of equal sentences the best hit stays; none below least."""
    kept = hits.filter(F.col(similarity) >= least).groupBy(post, sentence).agg(F.max_by(F.struct(sentence, F.round(similarity, 4).alias("confidence"), *more), similarity).alias("hit"))
    order = lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).when(a[sentence] < b[sentence], -1).when(a[sentence] > b[sentence], 1).otherwise(0)
    return kept.groupBy(post).agg(F.array_sort(F.collect_list("hit"), order).alias("hits"))


def valid_hits(posts: DataFrame, noun_patterns: list[str], nouns: list[str], least: float = 0.0, anchor: str = "nearest_anchor", pattern: str = "nearest_anchor_pattern") -> DataFrame:
    """posts with only hits whose pattern takes any word, or whose anchor ends in a known noun, of enough confidence; empty posts go."""
    last = lambda h: F.element_at(F.split(F.regexp_replace(h[anchor], r"(?U)[^\w\s]+$", ""), " "), -1)
    good = lambda h: (h["confidence"] >= least) & (~h[pattern].isin(*noun_patterns) | F.lower(last(h)).isin(*nouns))
    return posts.withColumn("hits", F.filter("hits", good)).filter(F.size("hits") > 0)


def anchors_from(templates: DataFrame, words: DataFrame) -> DataFrame:
    """sentence, name, word of each template (name, phrase, noun_only) with each word (word, noun) that suits it; sentences are distinct."""
    pairs = F.broadcast(templates).join(words, F.col("noun_only") == F.col("noun"))  # templates are a fixed table of some tens of rows
    made = pairs.select(F.concat_ws(" ", "phrase", "word").alias("sentence"), "name", "word")
    return made.groupBy("sentence").agg(F.min(F.struct("name", "word")).alias("m")).select("sentence", "m.name", "m.word")


def embedded(df: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], out: str = "embedding", prefix: str = "query: ") -> DataFrame:
    """df with unit vectors of an injected encoder, called on batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            v = np.asarray(encode([prefix + (t or "") for t in part]), np.float32).reshape(len(part), -1)
            yield pd.Series(list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)))

    return df.withColumn(out, run(text))
