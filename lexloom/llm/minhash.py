"""Near-duplicate detection: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

One hash of each shingle serves all bins: its high bits choose the bin, and a bin keeps its least value. An empty bin borrows the value
of a bin that a random function of (bin, attempt) names, at the first attempt that hits a filled one. Six bins make a band; documents
that agree on a band share a bucket. A bucket emits one edge from each member to its least one, a star, and not all pairs. Edges are
confirmed on full shingle sets. Links between two leaves of a star are then looked for only where a bucket still spans several
components: by the rare shingles they share, by further stars around the most central leaf, and by pairs that exact bounds leave over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHOLE, documents, fits_broadcast, fresh, materialize, named_ids, numbered_ids, small, text_or_empty

WORDS = 5
PERCENT = 85
BIN_BITS = 8
BAND = 6
#: A shingle is rare among the open leaves if no more of them hold it.
RARE = 8
SEED = 0x5EED_0F_B145
#: Leaves of a bucket that a task compares with the bucket's others, about.
TILE = 256

_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_bins = 1 << BIN_BITS
#: BORROW[attempt, bin]: the bin to borrow from.
BORROW = (_mixed(np.arange(4096 * _bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)) >> np.uint64(64 - BIN_BITS)).astype(np.int64).reshape(4096, _bins)
_FACTORS = _mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The ascending distinct 64-bit hashes of the shingles of a text in UTF-8. A-Z count as a-z; words end at space, \\t, \\n, \\v, \\f, \\r.

    With fewer words than a shingle has, the whole sequence is one; without words there is none.
    """
    parts = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, parts), np.uint64, len(parts))
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out += h[i : i + n] * _FACTORS[i]
    return np.unique(_mixed(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each bin, densified. shingles: ascending, at least one."""
    bins = (shingles >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    out = np.full(_bins, _FAR)
    filled = np.zeros(_bins, bool)
    out[bins[first]] = shingles[first]
    filled[bins[first]] = True
    empty, tried = np.flatnonzero(~filled), 0
    while len(empty) and tried < len(BORROW):
        lenders = BORROW[tried : tried + max(8, tried)][:, empty]
        tried += max(8, tried)
        hits = filled[lenders]
        ok = hits.any(axis=0)
        out[empty[ok]] = out[lenders[hits.argmax(axis=0), np.arange(len(empty))][ok]]
        empty = empty[~ok]
    for i in empty:  # no attempt of all has hit: the next filled bin
        out[i] = shingles[first[np.searchsorted(bins[first], i) % len(first)]]
    return out


def bands(sign: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band of BAND bins."""
    n = len(sign) // BAND
    rows = sign[: n * BAND].reshape(n, BAND)
    out = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(BAND):
        out = _mixed(out + rows[:, i] * _FACTORS[i])
    return out


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """rid, doc_id, n_shingles, d1 and d2 (a 128-bit digest of the set), keys (of the bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                n, d1, d2, keys = [], [], [], []
                for text in some.column(2).cast(pa.binary()).to_pylist():
                    s = shingle_set(text, words)
                    n.append(len(s))
                    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    d1.append(d[0])
                    d2.append(d[1])
                    keys.append(bands(signature(s)).view(np.int64) if len(s) else None)
                flat = np.concatenate([k for k in keys if k is not None] or [np.zeros(0, np.int64)])
                ends = np.cumsum([0] + [0 if k is None else len(k) for k in keys])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    ["rid", "doc_id", "n_shingles", "d1", "d2", "keys"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "rid bigint, doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, set: the shingles of the rows of docs whose doc_id is among ids (distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                sets = [shingle_set(t, words).view(np.int64) for t in some.column(1).cast(pa.binary()).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["id", "set"])

    ids = F.broadcast(ids) if fits_broadcast(ids, 16) else ids
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), text_or_empty().alias("text")).join(ids, "id", "left_semi")
    return rows.mapInArrow(run, "id bigint, set array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of pairs, with the sizes of their sets (n_a, n_b) and of the intersection (both)."""
    one = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    size = lambda x: F.size(x).cast("bigint")
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", size("set_a").alias("n_a"), size("set_b").alias("n_b"), size(F.array_intersect("set_a", "set_b")).alias("both"))


def components(edges: DataFrame) -> DataFrame:
    """Of edges (v, p) with p < v: v and its component's least member p, for each v that isn't that member itself.

    Rounds of pointing at parents' parents and joining a node's parents, until each node has one parent that has none. A round is
    written to the shared folder; nodes with many children are split by Spark's skewed joins, as one side has a row per node.
    """
    edges = materialize(edges.select("v", "p").distinct(), "links")
    while True:
        least = materialize(edges.groupBy("v").agg(F.min("p").alias("m"), F.count(F.lit(1)).alias("parents")), "parents")
        up = least.select(F.col("v").alias("p"), F.col("m").alias("top"))
        open_ends = least.filter("parents > 1").limit(1).count() or edges.join(up.select("p"), "p", "left_semi").limit(1).count()
        if not open_ends:
            return least.select("v", F.col("m").alias("p"))
        joined = edges.join(least.filter("parents > 1").select("v", "m"), "v", "left").select("v", "p", F.coalesce("m", "p").alias("m"))
        star = joined.select("v", F.col("m").alias("p")).unionByName(joined.filter("p <> m").select(F.col("p").alias("v"), F.col("m").alias("p"))).distinct()
        edges = materialize(star.join(up, "p", "left").select("v", F.coalesce("top", "p").alias("p")).distinct(), "links")


def _alike(n_a: Column, n_b: Column, percent: int) -> Column:
    """Sizes that allow a link."""
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent).cast("boolean")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For each row of docs (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id, kept.

    Two rows are linked if 100 * shared >= percent * all of their shingles. component_id is the least doc_id that links reach, kept
    whether that is the row's own. Rows without words (null or empty text, too) have no shingles and no links. Rows that repeat a
    doc_id count as linked; so do rows with equal sets. doc_ids are of any type that has an order; a row with a null doc_id has null for
    both and is kept. An empty table gives an empty result.
    """
    if dict(docs.dtypes)["doc_id"] not in WHOLE:
        numbered, ids = numbered_ids(docs.select("doc_id", "text"), "near-places")
        return named_ids(near_duplicates(numbered, words, percent), ids, "doc_id", "component_id")
    rows = materialize(_sketches(docs, words), "near-rows")
    named = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # Rows with equal sets are one class, named by its least doc_id; only classes with several rows are written.
    classes = materialize(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("d1", "d2", "class"), "near-classes")
    member = named.join(classes, ["d1", "d2"], "left").select("rid", "doc_id", F.coalesce("class", "doc_id").alias("class"), "n_shingles", "keys")
    heads = materialize(member.filter("doc_id = class").select(F.col("class").alias("id"), F.col("n_shingles").alias("n"), "keys"), "near-heads")
    buckets = heads.select("id", "n", F.explode("keys").alias("key"))
    # Stars: an edge from each member of a bucket to its least one.
    hubs = materialize(buckets.groupBy("key").agg(F.min("id").alias("hub"), F.min_by("n", "id").alias("n_hub"), F.max("id").alias("last"), F.count(F.lit(1)).alias("members")).filter("hub < last").drop("last"), "near-hubs")
    spokes = materialize(buckets.join(small(hubs, 40), "key").filter("id <> hub").select("key", "id", "n", "hub", "n_hub", "members"), "near-spokes")
    stars = spokes.filter(_alike(F.col("n"), F.col("n_hub"), percent)).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    stars = materialize(stars, "near-stars")
    crowded = spokes.filter("members > 2")
    ids = materialize(stars.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowded.select("id")).distinct(), "near-ids")
    sets = materialize(_sets(docs, ids, words).distinct(), "near-sets")
    checked = materialize(_confirmed(stars, sets), "near-checked")
    edges = checked.filter(_linked(percent)).select(F.col("a").alias("v"), F.col("b").alias("p"))
    # Rows that share a doc_id but not their set.
    spread = member.groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high")
    twins = member.join(spread, "doc_id").filter("class > low").select(F.col("class").alias("v"), F.col("low").alias("p"))
    found = materialize(components(edges.unionByName(twins)), "near-found")
    found = _between_leaves(crowded, checked, found, sets, percent)
    top = found.select(F.col("v").alias("class"), F.col("p").alias("top"))
    joined = rows.join(classes, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("class", "doc_id")).otherwise(F.col("doc_id")).alias("class")).join(top, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "class"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _linked(percent: int) -> Column:
    return F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent


def _open(leaves: DataFrame, found: DataFrame, label: str) -> DataFrame:
    """The leaves of buckets that hold leaves of several components, with their component's top."""
    top = found.select(F.col("v").alias("id"), F.col("p").alias("top"))
    named = leaves.drop("top").join(top, "id", "left").withColumn("top", F.coalesce("top", "id"))
    mixed = named.groupBy("key").agg(F.min("top").alias("low"), F.max("top").alias("high")).filter("low < high").select("key")
    return materialize(named.join(small(materialize(mixed, "near-mixed"), 16), "key", "left_semi"), label)


def _may_share(percent: int) -> Column:
    """Whether the shingles of a pair that aren't rare, n - rare, are enough for a link."""
    most = F.least(F.col("n_a") - F.col("rare_a"), F.col("n_b") - F.col("rare_b"))
    return most * 100 >= (F.col("n_a") + F.col("n_b") - most) * percent


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The confirmed ones of pairs (a, b), as edges from the greater to the lesser."""
    pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-pairs")
    return materialize(_confirmed(pairs, sets).filter(_linked(percent)).select(F.col("a").alias("v"), F.col("b").alias("p")), "near-links")


def _between_leaves(crowded: DataFrame, checked: DataFrame, found: DataFrame, sets: DataFrame, percent: int, rounds: int = 4) -> DataFrame:
    """found, joined by the links between leaves of one bucket that lie in different components.

    Shingles that at most RARE of these leaves hold are rare. Leaves that share a rare one are compared, as RARE bounds their pairs.
    Any other pair shares no rare shingle, so a leaf that is linked by such a pair has few; those with many are left out. Of the
    rest, the leaf with the fewest is the next hub of its bucket and gives another star; amid edited copies it links most of them.
    Stars go on while they link and a bucket's pairs outnumber its members by far. What is then still open is compared in pairs,
    without those that the bound on shared shingles or the distances to the first hub rule out. No step loses a link.
    """
    leaves = _open(crowded.select("key", "id", "n", "hub"), found, "near-open")
    if leaves.isEmpty():
        return found
    held = sets.join(leaves.select("id").distinct(), "id", "left_semi").select("id", F.explode("set").alias("shingle"))
    counts = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).filter(F.col("holders") <= RARE)
    rare = materialize(held.join(counts, "shingle"), "near-rare")
    tops = leaves.select("id", "n", "top").distinct()
    shared = rare.filter("holders > 1").join(tops, "id")
    one, two = (shared.select("shingle", *[F.col(c).alias(d + x) for c, d in (("id", ""), ("n", "n_"), ("top", "top_"))]) for x in "ab")
    pairs = one.join(two, "shingle").filter((F.col("b") < F.col("a")) & (F.col("top_a") != F.col("top_b")) & _alike(F.col("n_a"), F.col("n_b"), percent))
    found = materialize(components(found.unionByName(_links(pairs, sets, percent))), "near-found")
    few = rare.groupBy("id").agg(F.count(F.lit(1)).alias("rare"))
    leaves = leaves.join(few, "id", "left").withColumn("rare", F.coalesce("rare", F.lit(0))).filter((F.col("n") - F.col("rare")) * 100 >= F.col("n") * percent)
    leaves = _open(leaves, found, "near-open")
    for _ in range(rounds):
        sizes = leaves.groupBy("key").agg(F.count(F.lit(1)).alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs"), F.sum("m").alias("rows")).first()
        if not sizes["rows"]:
            return found
        if sizes["pairs"] <= 4 * sizes["rows"]:
            break
        center = materialize(leaves.groupBy("key").agg(F.min(F.struct("rare", "id", "n", "top")).alias("c")).select("key", F.col("c.id").alias("b"), F.col("c.n").alias("n_b"), F.col("c.rare").alias("rare_b"), F.col("c.top").alias("top_b")), "near-centers")
        star = leaves.select("key", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("rare").alias("rare_a"), F.col("top").alias("top_a")).join(small(center, 48), "key")
        links = _links(star.filter((F.col("a") != F.col("b")) & (F.col("top_a") != F.col("top_b")) & _may_share(percent)), sets, percent)
        leaves = leaves.join(center.select("key", F.col("b").alias("id")), ["key", "id"], "left_anti")
        if links.isEmpty():
            break
        found = materialize(components(found.unionByName(links)), "near-found")
        leaves = _open(leaves, found, "near-open")
    far = F.lit(1.0) - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    near = checked.groupBy(F.col("a").alias("id"), F.col("b").alias("hub")).agg(F.max(far).alias("far"), F.min(far).alias("least")).filter("far = least").drop("least")
    leaves = leaves.join(near, ["id", "hub"], "left")
    # A large bucket is cut into tiles: each leaf lies in one as b and is compared with all leaves as a, so no task gets all pairs of a bucket.
    tiles = materialize(leaves.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")), "near-tiles")
    leaves = materialize(leaves.join(small(tiles, 24), "key"), "near-tiled")
    one, two = (leaves.select("key", "tiles", *[F.col(c).alias(d + x) for c, d in (("id", ""), ("n", "n_"), ("rare", "rare_"), ("top", "top_"), ("far", "far_"))]) for x in "ab")
    one = one.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    two = two.withColumn("tile", F.pmod(F.xxhash64("b"), F.col("tiles")).cast("int")).drop("tiles")
    apart = F.coalesce(F.abs(F.col("far_a") - F.col("far_b")) <= (100 - percent) / 100 + 1e-9, F.lit(True))
    pairs = one.join(two, ["key", "tile"]).filter((F.col("b") < F.col("a")) & (F.col("top_a") != F.col("top_b")) & _alike(F.col("n_a"), F.col("n_b"), percent) & apart & _may_share(percent))
    return components(found.unionByName(_links(pairs, sets, percent)))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that near_duplicates keeps; all columns stay."""
    (id_,) = fresh(docs, "_id")
    gone = materialize(near_duplicates(docs, words, percent).filter("NOT kept").select(F.col("doc_id").alias(id_)).distinct(), "near-gone")
    gone = F.broadcast(gone) if fits_broadcast(gone, 16) else gone
    return docs.join(gone, F.col("doc_id") == F.col(id_), "left_anti")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: near-duplicates among all documents."""
    return near_duplicates(documents(spark, sf_dir))


#: DuckDB counts the shingles that each two documents share, without sketches or candidates.
OP9_SQL = r"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: md5_number(array_to_string(w[i : i + 4], ' ')))) END AS s FROM words),
alike AS (SELECT s, min(doc_id) AS head FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
held AS (SELECT head, len(s) AS n, unnest(s) AS h FROM alike),
pairs AS (SELECT a.head AS a, b.head AS b FROM held a JOIN held b ON a.h = b.h AND a.head < b.head GROUP BY a.head, b.head, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a AS head, a AS seen FROM links UNION SELECT r.head, l.b FROM reach r JOIN links l ON r.seen = l.a),
tops AS (SELECT head, min(seen) AS top FROM reach GROUP BY head)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(t.top, a.head, d.doc_id) AS component_id, d.doc_id = coalesce(t.top, a.head, d.doc_id) AS kept
FROM sets d LEFT JOIN alike a ON list_sort(d.s) = a.s LEFT JOIN tops t ON t.head = a.head"""
