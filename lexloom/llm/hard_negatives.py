"""Hard-negative mining: vantage-point trees over norm-augmented vectors, searched nearest first inside distance annuli.

With R the largest norm, a vector v gets one more component, sqrt(R^2 - |v|^2), so all lie on a sphere. The squared distance from a query q
(with a zero there) is |q|^2 + R^2 - 2 q.v: the largest inner products are the nearest rows, and a window of scores is an annulus.

Trees have two levels. The upper one is fitted on a bounded sample and routes every row to a leaf; the rows of a leaf are dealt to blocks of
bounded size, and each block holds a tree of its own over its rows. A node's vantage point keeps the least and the greatest distance to the
rows of each leaf below it, which by the triangle inequality bounds the distances from a query to them. A search first visits the query's own
leaf, whose k-th best score then bounds what is worth a visit elsewhere, and goes through the buckets of a block nearest first until the
next one can't hold a better row. Bounds are kept with slack, scores are whole numbers, and nothing is cut short: results are exact.

Queries meet blocks by a join on (leaf, block) that the upper tree has selected, in groups of bounded size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .vectors import embeddings, lists, matrix, measured, usable, whole

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
ANCHOR_EVERY = 100
#: Rows that the upper tree is fitted on, at most, and its leaves, at most. Every row is routed and indexed.
SAMPLE, LEAVES = 4096, 1024
#: Rows of a leaf and of a block, about; rows of a bucket of a block's tree, at most.
LEAF_ROWS, BLOCK_ROWS, BUCKET = 2048, 2048, 64
#: Anchors of a group that is sent to blocks together, about, and searches that go on at once in a task.
GROUP, AT_ONCE = 128, 256
#: The lowest score, beyond any.
NEVER = -(1 << 62)


class Tree:
    """A vantage-point tree: which leaf a vector belongs to, and what each leaf's rows are away from the vantage points above it.

    points: vectors of the vantage points, with their last component in heights. steps[leaf]: the nodes on the way to it. low, high: the
    least and greatest distance of the leaf's rows to each of these.
    """

    def __init__(self, vectors: np.ndarray, radius2: float, leaves: int, seed: int = 0) -> None:
        self.radius2, self.points, self.heights, self.cuts, self.kids = radius2, [], [], [], []
        self.steps: list[list[int]] = []
        rng = np.random.default_rng(seed)
        x = vectors.astype(np.float64)
        h = np.sqrt(np.maximum(radius2 - (x * x).sum(axis=1), 0))
        self.members: list[np.ndarray] = []

        def grow(rows: np.ndarray, leaves: int, way: list[int]) -> int:
            """The number of a node, or -1 - leaf."""
            if leaves > 1 and len(rows) > 1:
                top = rows[rng.integers(len(rows))]
                d = self._apart(x[rows], h[rows], x[top], h[top])
                cut = float(np.median(d))
                near = d <= cut
                if near.all():
                    cut = float(np.nextafter(d.max(), 0))
                    near = d <= cut
                if 0 < near.sum() < len(rows):
                    at = len(self.points)
                    self.points.append(vectors[top].astype(np.int64))
                    self.heights.append(h[top])
                    self.cuts.append(cut)
                    self.kids.append([0, 0])
                    self.kids[at] = [grow(rows[near], leaves // 2, [*way, at]), grow(rows[~near], leaves - leaves // 2, [*way, at])]
                    return at
            self.steps.append(way)
            self.members.append(rows)
            return -len(self.steps)

        self.root = grow(np.arange(len(x)), max(1, leaves), [])
        self.points = np.array(self.points, np.int64).reshape(len(self.heights), vectors.shape[1])
        self.heights = np.array(self.heights)
        depth = max(map(len, self.steps), default=0)
        self.way = np.full((len(self.steps), depth), -1)
        for i, way in enumerate(self.steps):
            self.way[i, : len(way)] = way

    @staticmethod
    def _apart(x: np.ndarray, hx: np.ndarray, y: np.ndarray, hy: float) -> np.ndarray:
        return np.sqrt(((x - y) ** 2).sum(axis=1) + (hx - hy) ** 2)

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        x = vectors.astype(np.float64)
        h = np.sqrt(np.maximum(self.radius2 - (x * x).sum(axis=1), 0))
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                near = self._apart(x[rows], h[rows], self.points[node], self.heights[node]) <= self.cuts[node]
                todo += [(self.kids[node][0], rows[near]), (self.kids[node][1], rows[~near])]
        return out

    def spans(self, vectors: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest distances of some rows of a leaf to the vantage points on the way to it."""
        x = vectors.astype(np.float64)
        h = np.sqrt(np.maximum(self.radius2 - (x * x).sum(axis=1), 0))
        d = [self._apart(x, h, self.points[p], self.heights[p]) for p in self.steps[leaf]]
        return np.array([v.min() for v in d]), np.array([v.max() for v in d])

    def bounds(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and leaf, the greatest and the least inner product that its rows can have. low, high: of leaves, as in way."""
        q = queries.astype(np.float64)
        square = (q * q).sum(axis=1)
        slack = 1e-9 * (square + self.radius2) + 1e-3
        far = np.sqrt(np.maximum(square[:, None] + self.radius2 - 2 * q @ self.points.T.astype(np.float64), 0)) if len(self.points) else np.zeros((len(q), 0))
        least, most = np.zeros((len(q), len(self.way))), np.full((len(q), len(self.way)), np.inf)
        for j in range(self.way.shape[1]):
            there = self.way[:, j] >= 0
            d = far[:, self.way[there, j]]
            least[:, there] = np.maximum(least[:, there], np.maximum(d - high[there, j], low[there, j] - d))
            most[:, there] = np.minimum(most[:, there], d + high[there, j])
        score = lambda d: (square[:, None] + self.radius2 - d * d) / 2
        return score(least) + slack[:, None], score(most) - slack[:, None]


def padded(tree: Tree, spans: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """low and high as matrices; a leaf without rows has an empty span, so no query visits it."""
    low, high = np.full(tree.way.shape, np.inf), np.full(tree.way.shape, -np.inf)
    for leaf, (a, b) in spans.items():
        low[leaf, : len(a)], high[leaf, : len(b)] = a, b
    return low, high


class Block:
    """The rows of a block in the order of its tree's buckets."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, rids: np.ndarray, radius2: float) -> None:
        leaves = 1 << max(0, int(np.ceil(np.log2(max(1, len(vectors) / BUCKET)))))
        self.tree = tree = Tree(vectors, radius2, leaves)
        self.low, self.high = padded(tree, {i: tree.spans(vectors[m], i) for i, m in enumerate(tree.members)})
        order = np.concatenate(tree.members)
        sizes = [len(m) for m in tree.members]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.vectors, self.ids, self.labels, self.rids = vectors[order], ids[order], labels[order], rids[order]
        del tree.members

    def search(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, label: np.ndarray, same: bool, rid: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the first k rows for each query: those with a score from low to high, at least floor, of the same or of another label.

        Higher scores come first, ties by the smaller id; NEVER stands where there are fewer. Row rid takes no part.
        """
        n, width = len(q), int(np.diff(self.starts).max())
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * q.shape[1] < 2**52
        kind = np.float64 if exact else np.int64
        best, ids = np.full((n, k), NEVER), np.full((n, k), np.iinfo(np.int64).max)
        upper, lower = self.tree.bounds(q, self.low, self.high)
        upper = np.minimum(np.floor(np.clip(upper, -(2.0**61), 2.0**61)).astype(np.int64), high[:, None])
        upper[(lower > high[:, None]) | (upper < np.maximum(low, floor)[:, None])] = NEVER
        order = np.argsort(-upper, axis=1, kind="stable")
        q = q.astype(kind)
        for s in range(order.shape[1]):
            bucket = order[:, s]
            reach = upper[np.arange(n), bucket]
            active = np.flatnonzero((reach > NEVER) & (reach >= best[:, -1]))
            if not len(active):
                break
            at = self.starts[bucket[active]][:, None] + np.arange(width)[None, :]
            there = at < self.starts[bucket[active] + 1][:, None]
            at = np.where(there, at, 0)
            score = (self.vectors[at].astype(kind) @ q[active][:, :, None])[:, :, 0].astype(np.int64)
            fits = there & ((self.labels[at] == label[active][:, None]) == same) & (self.rids[at] != rid[active][:, None])
            fits &= (score >= np.maximum(low, floor)[active][:, None]) & (score <= high[active][:, None])
            score = np.concatenate([best[active], np.where(fits, score, NEVER)], axis=1)
            found = np.concatenate([ids[active], np.where(fits, self.ids[at], np.iinfo(np.int64).max)], axis=1)
            first = np.lexsort((found, -score), axis=1)[:, :k]
            best[active], ids[active] = np.take_along_axis(score, first, 1), np.take_along_axis(found, first, 1)
        return best, ids


def _prepared(rows: DataFrame) -> DataFrame:
    """rid, vec_id, label (moved where vec_id is divisible by 7), v: the rows that take part."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    kept = rows.filter(F.col("label").isNotNull() & usable())
    return kept.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("bigint").alias("vec_id"), moved.cast("bigint").alias("label"), whole("embedding", SCALE).alias("v"))


def _index(rows: DataFrame, tree: Tree, width: int) -> DataFrame:
    """leaf, block, low, high, body: the rows of each block with their tree."""
    radius2 = tree.radius2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> Iterator[pa.RecordBatch]:
            some = pa.Table.from_batches(held).combine_chunks()
            ids = some["vec_id"].fill_null(np.iinfo(np.int64).max - 1)  # last among ties
            leaf = some["leaf"][0].as_py()
            x = matrix(some["v"].combine_chunks(), width)
            low, high = tree.spans(x, leaf)
            body = pickle.dumps(Block(x.astype(np.int32), *[c.to_numpy() for c in (ids, some["label"], some["rid"])], radius2), 5)
            yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([some["block"][0].as_py()], pa.int64()), *[lists(a[None, :], pa.float64()) for a in (low, high)], pa.array([body], pa.binary())], ["leaf", "block", "low", "high", "body"])

        key = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
            ends = [*np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            start = 0
            for end in ends:
                if end > start:
                    if held and tuple(keys[start]) != key:
                        yield from made()
                        held.clear()
                    key = tuple(keys[start])
                    held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield from made()

    sizes = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))  # at most LEAVES rows
    dealt = rows.join(F.broadcast(sizes), "leaf").select("leaf", F.pmod(F.xxhash64("rid"), F.col("blocks")).alias("block"), "rid", "vec_id", "label", "v")
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    return dealt.repartition(n, "leaf", "block").sortWithinPartitions("leaf", "block").mapInArrow(build, "leaf bigint, block bigint, low array<double>, high array<double>, body binary")


_ITEM = ("rid", "slot", "v", "low", "high", "label", "floor")


class Index:
    """The blocks of all rows, and the directory of the upper tree's leaves, which has at most LEAVES rows."""

    def __init__(self, rows: DataFrame, width: int, radius2: float) -> None:
        self.spark, self.width = rows.sparkSession, width
        n = rows.count()
        sample = rows.select("v").orderBy(F.xxhash64("rid")).limit(SAMPLE).collect()
        x = np.zeros((len(sample), width), np.int64)
        for i, r in enumerate(sample):
            x[i, : len(r["v"])] = r["v"]
        self.tree = tree = Tree(x, radius2, int(np.clip(-(-n // LEAF_ROWS), 1, LEAVES)))
        del tree.members

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.route(matrix(b.column(3), width)), pa.int64())], ["rid", "vec_id", "label", "v", "leaf"])

        self.rows = common.materialize(rows.mapInArrow(route, "rid bigint, vec_id bigint, label bigint, v array<bigint>, leaf bigint"), "negatives-rows")
        self.blocks = common.materialize(_index(self.rows, tree, width), "negatives-index")
        spans, self.counts = {}, np.zeros(len(tree.steps), np.int64)
        for r in self.blocks.groupBy("leaf").agg(F.max("block").alias("last")).collect():
            self.counts[r["leaf"]] = r["last"] + 1
            spans[r["leaf"]] = [np.full(len(tree.steps[r["leaf"]]), v) for v in (np.inf, -np.inf)]
        for c, f, i in (("low", F.min, 0), ("high", F.max, 1)):
            for r in self.blocks.select("leaf", F.posexplode(c)).groupBy("leaf", "pos").agg(f("col").alias("d")).collect():  # at most LEAVES rows per level
                spans[r["leaf"]][i][r["pos"]] = r["d"]
        self.low, self.high = padded(tree, spans)

    def _visits(self, items: DataFrame, home: bool) -> DataFrame:
        """items (with leaf and team), once per leaf and block that they have to visit; home: only their own leaf, or all but that."""
        tree, low, high, counts, width = self.tree, self.low, self.high, self.counts, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole_batch in batches:
                for i in range(0, whole_batch.num_rows, AT_ONCE):
                    b = whole_batch.slice(i, AT_ONCE)
                    col = {n: b.column(j) for j, n in enumerate(b.schema.names)}
                    own = col["leaf"].to_numpy()
                    if home:
                        go = np.zeros((len(own), len(counts)), bool)
                        go[np.arange(len(own)), own] = True
                    else:
                        upper, lower = tree.bounds(matrix(col["v"], width), low, high)
                        least = np.maximum(col["low"].to_numpy(), col["floor"].to_numpy())
                        go = (upper >= least[:, None]) & (lower <= col["high"].to_numpy()[:, None])
                        go[np.arange(len(own)), own] = False
                    item, leaf = np.nonzero(go & (counts > 0)[None, :])
                    item, leaf = np.repeat(item, counts[leaf]), np.repeat(leaf, counts[leaf])
                    turn = np.arange(len(leaf)) - np.searchsorted(leaf + item * len(counts), leaf + item * len(counts))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(turn, pa.int64()), col["team"].take(pa.array(item)), *[col[n].take(pa.array(item)) for n in _ITEM]], ["at_leaf", "at_block", "team", *_ITEM])

        shape = "at_leaf bigint, at_block bigint, team string, rid bigint, slot int, v array<bigint>, low bigint, high bigint, label bigint, floor bigint"
        return items.select("leaf", "team", *_ITEM).mapInArrow(run, shape)

    def _searched(self, items: DataFrame, home: bool, same: bool, k: int) -> DataFrame:
        """rid, slot, score, id: up to k rows of each block for each item that visits it."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block = pickle.loads(batch.column(1)[i].as_py())
                    some = batch.column(0)[i].values
                    for j in range(0, len(some), AT_ONCE):
                        one = some.slice(j, AT_ONCE)
                        col = {n: one.field(n) for n in _ITEM}
                        num = {n: col[n].to_numpy(zero_copy_only=False) for n in ("rid", "slot", "low", "high", "label", "floor")}
                        best, ids = block.search(matrix(col["v"], width), num["low"], num["high"], num["label"], same, num["rid"], num["floor"], k)
                        at, place = np.nonzero(best > NEVER)
                        yield pa.RecordBatch.from_arrays([pa.array(num["rid"][at], pa.int64()), pa.array(num["slot"][at], pa.int32()), pa.array(best[at, place], pa.int64()), pa.array(ids[at, place], pa.int64())], ["rid", "slot", "score", "id"])

        teams = self._visits(items, home).groupBy("at_leaf", "at_block", "team").agg(F.collect_list(F.struct(*_ITEM)).alias("items"))  # at most about GROUP anchors
        pairs = teams.join(self.blocks.select(F.col("leaf").alias("at_leaf"), F.col("block").alias("at_block"), "body"), ["at_leaf", "at_block"])
        return pairs.select("items", "body").mapInArrow(run, "rid bigint, slot int, score bigint, id bigint")

    def nearest(self, items: DataFrame, same: bool, k: int) -> DataFrame:
        """rid, slot, score, id, place (from 1): the first k rows for each item (rid, slot, v, low, high, label, leaf, team)."""
        ranked = Window.partitionBy("rid", "slot").orderBy(F.desc("score"), "id")
        first = lambda df: df.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k)
        items = items.withColumn("floor", F.lit(NEVER))
        near = common.materialize(first(self._searched(items, True, same, k)), "negatives-near")
        full = near.filter(F.col("place") == k).select("rid", "slot", F.col("score").alias("kth"))
        rest = items.join(common.small(full, 32), ["rid", "slot"], "left").withColumn("floor", F.coalesce("kth", "floor")).drop("kth")
        found = common.materialize(self._searched(rest, False, same, k), "negatives-far")
        return first(near.drop("place").unionByName(found))


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor_every: int = ANCHOR_EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor among rows (vec_id, embedding, label) and each
    of its first positives, the first negatives among rows of another label whose score is from low to high percent of the positive's.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A row's score is the inner product of
    floor(256 * x) with the anchor's; higher scores come first, ties by the smaller vec_id (null last). Where vec_id is divisible by 7, the
    label first becomes (label + 1) % 10. Anchors are rows whose vec_id is divisible by anchor_every; rows that repeat a vec_id are rows of
    their own, so an anchor given twice has results twice. Missing components of vectors that are shorter than others count as zero. Scores
    are 64-bit numbers; components too large for that are an error. Positives with a negative score have no window. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    n, width, most = measured(rows.filter(F.col("label").isNotNull() & usable()), "embedding", SCALE)
    shape = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n:
        return spark.createDataFrame([], shape)
    width = max(1, width)
    if width * most * most * 200 >= 2**62 or most >= 2**31 - 1:
        raise ValueError("components are too large for 64-bit scores")
    kept = common.materialize(_prepared(rows), "negatives-kept")
    radius2 = kept.agg(F.max(F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x))).first()[0]
    index = Index(kept, width, float(radius2) * (1 + 1e-12))
    anchors = index.rows.filter(F.col("vec_id") % anchor_every == 0)
    crowds = F.broadcast(anchors.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("teams")))  # at most LEAVES rows
    anchors = anchors.join(crowds, "leaf").select("rid", "vec_id", "v", "label", "leaf", F.concat_ws("-", "leaf", F.pmod(F.xxhash64("rid"), F.col("teams"))).alias("team"))
    anchors = common.materialize(anchors, "negatives-anchors")
    every = anchors.select("rid", F.lit(0).alias("slot"), "v", F.lit(NEVER).alias("low"), F.lit(-NEVER).alias("high"), "label", "leaf", "team")
    chosen = common.materialize(index.nearest(every, True, positives).select("rid", F.col("place").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    windows = chosen.filter("positive_score >= 0").select("rid", "slot", F.expr(f"(positive_score * {low} + 99) DIV 100").alias("low"), (F.expr(f"(positive_score * {high}) DIV 100")).alias("high"))
    items = anchors.join(windows.filter("low <= high"), "rid").select("rid", "slot", "v", "low", "high", "label", "leaf", "team")
    found = index.nearest(items, False, negatives)
    named = anchors.select("rid", F.col("vec_id").alias("anchor_id"))
    whole_id = lambda c: F.when(F.col(c) < (1 << 63) - 2, F.col(c))
    return found.join(chosen, ["rid", "slot"]).join(named, "rid").select(
        "anchor_id", whole_id("positive_id").alias("positive_id"), F.col("place").cast("int").alias("rank"), whole_id("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: hard negatives of all anchors among all embeddings."""
    return hard_negatives(embeddings(spark, sf_dir))


#: DuckDB scores all rows for each anchor.
OP11_SQL = """WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
FROM kept a JOIN kept r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10"""
