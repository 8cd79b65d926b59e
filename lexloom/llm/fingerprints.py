"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs. Native columns only.

A text of any length is cut into lines and, as it may have but one, into sentences as well; a sentence is cut again after every 256 code
points, as some texts have no sentence marks. The digest of a piece is 32 hash bits, 12 bits of which one is set in each group of four,
and 20 check bits that depend on the others. A sketch is a row of shards; a digest's first bits choose its shard and its twelve bits a
cell in each of the shard's three tables of four. A cell holds the XOR of its digests; check bits stand in for counts.

Two fingerprints are compared by their cells: the one with more shards is folded to the size of the other, and cells are subtracted
(XORed) shard by shard, so what two texts share cancels. Peeling takes digests out of cells that hold just one, as check bits show; that
uncovers more such cells, until the difference is empty. The digests taken out are the pieces that differ. If a shard gets stuck, larger
sketches of both texts are subtracted, of which the fingerprints are the folded form; what is stuck there is made again at four times the
size, and at last compared digest by digest. A cell that holds several digests passes for one with probability 2**-20; its shard then
ends stuck, as a digest that isn't there is left in its cells, and is made again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHOLE, documents, fresh, materialize, named_ids, numbered_ids, text_or_empty

#: Where lines end, and what a sentence (or a part of one) consists of.
CUT, FINE = r"\n+", r"[^\n.!?|]{1,256}"
CELLS, CHECK = 12, 20
#: Digests that a shard of a fingerprint should hold on average, at most.
FILL = 8
#: And of two texts together, in the larger sketches, where they don't cancel.
SPARSE = 8
ROUNDS, RETRIES = 3, 2
#: Rows that lie together when each row looks for the next, and the most such buckets.
BUCKET_ROWS, BUCKETS = 1024, 1 << 16
#: Bytes of text that a task should get when rows move to their buckets.
TASK_BYTES = 16 << 20

_long = lambda x: F.lit(x).cast("bigint")


def _check(body: Column) -> Column:
    return F.xxhash64(body).bitwiseAND(_long((1 << CHECK) - 1))


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of the text's lines and sentences."""
    cut = F.concat(F.split(text, CUT), F.regexp_extract_all(text, F.lit(FINE), F.lit(0)))
    parts = F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: p != "")
    bodies = F.transform(F.transform(parts, lambda p: F.xxhash64(p)), _body)
    return F.array_distinct(F.transform(bodies, lambda b: F.shiftleft(b, CHECK).bitwiseOR(_check(b))))


def _body(h: Column) -> Column:
    """32 bits of a hash, and for each of three further pairs of its bits one set bit of four."""
    slots = [F.element_at(F.array(*[_long(1 << (4 * t + i)) for i in range(4)]), (F.shiftrightunsigned(h, 2 * t).bitwiseAND(_long(3)) + 1).cast("int")) for t in range(3)]
    return F.shiftleft(F.shiftrightunsigned(h, 32), CELLS).bitwiseOR(slots[0]).bitwiseOR(slots[1]).bitwiseOR(slots[2])


def _let(x: Column, f) -> Column:
    """f(x), where x is worked out once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _shards(items: Column, bits: Column) -> Column:
    """items dealt to 2**bits arrays by their first bits, in the order of signed numbers.

    Each shard has a mark: its first bits, followed by zeros, so no cell holds it. In a sort it comes right before the shard's items.
    """

    def dealt(s: Column) -> Column:
        marks = F.array_compact(F.transform(s, lambda x, i: F.when(x.bitwiseAND(_long(((1 << CELLS) - 1) << CHECK)) == 0, i + 1)))
        return _let(marks, lambda at: F.transform(at, lambda a, k: F.slice(s, a + 1, F.coalesce(F.get(at, k + 1), F.size(s) + 1) - a - 1)))

    marks = _let(bits, lambda b: F.transform(F.sequence(_long(0), F.call_function("shiftleft", _long(1), b) - 1), lambda i: F.when(b == 0, _long(-(1 << 63))).otherwise(F.call_function("shiftleft", i, 64 - b))))
    return _let(F.sort_array(F.concat(items, marks)), dealt)


def _holds(x: Column, cell: int) -> Column:
    return x.bitwiseAND(_long(1 << (CHECK + cell))) != 0


def _xors(items: Column, cells: Column | None = None) -> Column:
    """The XOR of each cell of a shard, starting from cells or from zero."""
    add = lambda i: lambda a, x: F.when(_holds(x, i), a.bitwiseXOR(x)).otherwise(a)
    return F.array(*[F.aggregate(items, _long(0) if cells is None else F.get(cells, F.lit(i)), add(i)) for i in range(CELLS)])


def sketch(items: Column, bits: Column) -> Column:
    """array<array<bigint>>: the XORs of the cells of each of 2**bits shards."""
    return F.transform(_shards(items, bits), lambda some: _xors(some))


def size_bits(n: Column, fill: int = FILL) -> Column:
    """The logarithm of the shards for n digests."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(1)) / float(fill))), F.lit(0)), F.lit(24)).cast("int")


def encoded(n: Column, cells: Column) -> Column:
    """A fingerprint as text: base64 of the number of digests and of all cells, eight bytes each, big-endian."""
    return F.base64(F.unhex(F.array_join(F.transform(F.concat(F.array(n.cast("bigint")), F.flatten(cells)), lambda k: F.lpad(F.hex(k), 16, "0")), "")))


def decoded(fingerprint: Column) -> Column:
    """struct<n, cells> of a fingerprint's text."""
    digits = F.hex(F.unbase64(fingerprint))
    numbers = F.transform(F.regexp_extract_all(digits, F.lit("[0-9A-F]{16}"), F.lit(0)), lambda h: F.conv(h, 16, -10).cast("bigint"))
    shards = lambda x: F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / CELLS).cast("int") - 1), lambda i: F.slice(x, i * CELLS + 2, CELLS))
    return _let(numbers, lambda x: F.struct(F.get(x, F.lit(0)).alias("n"), shards(x).alias("cells")))


def folded(cells: Column, shards: Column) -> Column:
    """A sketch of fewer shards: the shards of a longer prefix of bits lie side by side, and their cells add up."""
    zero = F.array(*[_long(0)] * CELLS)
    add = lambda some: F.aggregate(some, zero, lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q)))
    group = (F.size(cells) / shards).cast("int")
    return F.when(F.size(cells) == shards, cells).otherwise(F.transform(F.sequence(F.lit(0), shards - 1), lambda i: add(F.slice(cells, i * group + 1, group))))


def subtracted(x: Column, y: Column) -> Column:
    """The difference of the cells of two shards."""
    return F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))


def _peeled(cells: Column) -> Column:
    """struct<out, stuck>: the digests taken out of a shard's difference, and whether any are left.

    Steps alternate: one finds the cells that hold a single digest, the next takes those digests out of all their cells.
    """
    nothing = F.array().cast("array<bigint>")

    def step(acc: Column, i: Column) -> Column:
        alone = F.filter(acc["cells"], lambda x: (x != 0) & (_check(F.shiftrightunsigned(x, CHECK)) == x.bitwiseAND(_long((1 << CHECK) - 1))))
        look = F.struct(acc["cells"].alias("cells"), F.array_distinct(alone).alias("pure"), acc["out"].alias("out"))
        take = F.struct(_xors(acc["pure"], acc["cells"]).alias("cells"), nothing.alias("pure"), F.concat(acc["out"], acc["pure"]).alias("out"))
        return F.when(i % 2 == 1, look).when(F.size(acc["pure"]) == 0, acc).otherwise(take)

    start = F.struct(cells.alias("cells"), nothing.alias("pure"), nothing.alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * ROUNDS)), start, step, lambda s: F.struct(s["out"].alias("out"), F.exists(s["cells"], lambda c: c != 0).alias("stuck")))


def peeled(x: Column, y: Column) -> Column:
    """array<struct<out, stuck>>: for each shard of the smaller of two sketches, the digests that differ."""
    shards = F.least(F.size(x), F.size(y))
    return F.zip_with(folded(x, shards), folded(y, shards), lambda p, q: _peeled(subtracted(p, q)))


def _compared(shards: Column) -> Column:
    """shards: array<struct<a, b>>, digests of two texts. With d: those that differ, peeled from the subtracted cells, and whether any are stuck."""
    return F.transform(shards, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), _peeled(subtracted(_xors(s["a"]), _xors(s["b"]))).alias("d")))


def _finer(k: int, bits: Column):
    """Deals the digests of a shard to four by the next two bits after the first ones (and those that earlier retries used)."""

    def parts(s: Column) -> Column:
        turn = lambda x: F.call_function("shiftrightunsigned", x, 64 - 2 * k - bits).bitwiseAND(_long(3))
        own = lambda c, i: F.filter(s[c], lambda x: turn(x) == i).alias(c)
        return F.array(*[F.struct(own("a", i), own("b", i)) for i in range(4)])

    return parts


def with_sketches(df: DataFrame, *names: str) -> DataFrame:
    """df with, for each column of digests named, its digests dealt to shards (_dealt), the sketch of these (_large) and its fingerprint's cells (_cells).

    The large sketches of a row have one size, for the most digests that two of the texts can differ by.
    """
    first, *others = [F.size(c) for c in names]
    bits = size_bits(first + (F.greatest(*others) if len(others) > 1 else others[0]), SPARSE)
    df = df.withColumn("_bits", bits)
    for c in names:
        df = df.withColumn(f"{c}_dealt", _shards(F.col(c), F.col("_bits")))
    for c in names:
        df = df.withColumn(f"{c}_large", F.transform(f"{c}_dealt", lambda some: _xors(some)))
    for c in names:
        df = df.withColumn(f"{c}_cells", folded(F.col(f"{c}_large"), F.call_function("shiftleft", F.lit(1), size_bits(F.size(c)))))
    return df


def with_difference(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with out: the digests that only one of two columns of digests (with their sketches) holds.

    They are peeled from the difference of the two fingerprints. Where that gets stuck, the large sketches are subtracted, and of their
    stuck shards sketches are made again at four times the size, RETRIES times; what is left is compared digest by digest.
    """
    first, large, *names = [f"_{out}{k}" for k in range(RETRIES + 2)]
    df = df.withColumn(first, peeled(F.col(f"{a}_cells"), F.col(f"{b}_cells")))
    again = F.exists(first, lambda s: s["stuck"])
    df = df.withColumn(large, F.when(again, F.zip_with(f"{a}_large", f"{b}_large", lambda p, q: _peeled(subtracted(p, q)))))
    any_stuck = lambda name: F.exists(name, lambda s: s["d"]["stuck"])
    stuck = lambda name: F.filter(F.col(name), lambda s: s["d"]["stuck"])
    held = lambda i: F.struct(F.get(f"{a}_dealt", i - 1).alias("a"), F.get(f"{b}_dealt", i - 1).alias("b"))
    pairs = F.transform(F.filter(F.sequence(F.lit(1), F.size(large)), lambda i: F.get(large, i - 1)["stuck"]), held)
    for k, name in enumerate(names, 1):
        df = df.withColumn(name, F.when(F.exists(large, lambda s: s["stuck"]) if k == 1 else any_stuck(names[k - 2]), _compared(F.flatten(F.transform(pairs, _finer(k, F.col("_bits")))))))
        pairs = stuck(name)
    none = F.array().cast("array<bigint>")
    free = lambda found, one: F.coalesce(F.flatten(F.transform(found, one)), none)
    found = [free(F.filter(F.col(large), lambda s: ~s["stuck"]), lambda s: s["out"])]
    found += [free(F.filter(F.col(n), lambda s: ~s["d"]["stuck"]), lambda s: s["d"]["out"]) for n in names]
    exact = free(pairs, lambda s: F.concat(F.array_except(s["a"], s["b"]), F.array_except(s["b"], s["a"])))
    return df.withColumn(out, F.when(again, F.concat(*found, exact)).otherwise(F.flatten(F.transform(first, lambda s: s["out"])))).drop(first, large, *names)


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Shared over all distinct pieces, from the numbers of digests of two texts and the digests that differ; 1 if there are none."""
    both = a + b
    return F.when(both == 0, 1.0).otherwise((both - F.size(differing)) / (both + F.size(differing)))


def compared(df: DataFrame, a: str, b: str, near: str = "near", differing: str = "differing", stuck: str = "stuck") -> DataFrame:
    """df with what two columns of stored fingerprints tell without their texts: the digests that differ, the likeness, and stuck.

    Where stuck is true, the difference is too large for the smaller fingerprint; differing and near are null, and larger sketches of
    the texts (``with_difference``) are needed.
    """
    one, two, (seen,) = decoded(F.col(a)), decoded(F.col(b)), fresh(df, "_seen")
    df = df.withColumn(seen, _let(F.struct(one.alias("a"), two.alias("b")), lambda x: F.struct(x["a"]["n"].alias("a"), x["b"]["n"].alias("b"), peeled(x["a"]["cells"], x["b"]["cells"]).alias("d"))))
    df = df.withColumn(stuck, F.exists(F.col(seen)["d"], lambda s: s["stuck"]))
    df = df.withColumn(differing, F.when(~F.col(stuck), F.flatten(F.transform(F.col(seen)["d"], lambda s: s["out"]))))
    return df.withColumn(near, F.when(~F.col(stuck), likeness(F.col(seen)["a"], F.col(seen)["b"], F.col(differing)))).drop(seen)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, pieces (its digests), following, following_pieces: each row with the next one in descending doc_id order; the last is followed by the first.

    doc_id is an integer. Null doc_ids come last; equal doc_ids go by text. doc_ids are mapped to buckets in their order (by quantiles,
    and evenly within one); each bucket also gets a copy of the first row of the next, so rows move once and no task sees more than its
    buckets. A single doc_id that very many rows share is one bucket.
    """
    ids = docs.select("doc_id")
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    rows = max(BUCKET_ROWS, n // BUCKETS)
    ends = min(256, max(1, n // rows))
    cuts = ids.select(F.percentile_approx("doc_id", [i / ends for i in range(ends + 1)], 10_000)).first()[0] or [0]
    cuts = sorted(set(cuts))
    inner = max(1, n // (rows * len(cuts)))
    at = F.size(F.filter(F.array(*map(_long, cuts)), lambda c: c <= F.col("doc_id")))
    known = F.array(*map(_long, [cuts[0] - 1, *cuts, cuts[-1] + 1]))
    low, high = F.element_at(known, at + 1), F.element_at(known, F.least(at + 2, F.lit(len(cuts) + 2)))
    part = F.least(F.greatest(F.floor((F.col("doc_id") - low) / F.greatest(high - low, _long(1)) * inner), _long(0)), _long(inner - 1))
    bucket = F.when(F.col("doc_id").isNull(), _long(-1)).otherwise(at.cast("bigint") * inner + part)
    order = Window.orderBy(F.col("bucket").desc())
    firsts = ids.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("head"))
    follow = firsts.select("bucket", F.when(F.lead("bucket").over(order).isNotNull(), F.lead("head").over(order)).otherwise(F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    follow = F.broadcast(materialize(follow, "next-heads"))  # at most one row per bucket
    own = docs.select("doc_id", text_or_empty().alias("text"), bucket.alias("bucket"), F.lit(False).alias("copy"))
    copies = own.drop("bucket").join(follow, F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", "bucket", F.lit(True).alias("copy"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // TASK_BYTES))
    both = own.unionByName(copies).withColumn("pieces", digests(F.col("text"))).repartition(tasks, "bucket")
    window = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    both = both.select("doc_id", "text", "pieces", "copy", F.lead(F.struct("text", "pieces")).over(window).alias("next"))
    return both.filter("NOT copy").select("doc_id", "text", "pieces", F.col("next.text").alias("following"), F.col("next.pieces").alias("following_pieces"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs (doc_id, text).

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's. near_* is the share of distinct pieces in common, from the subtracted cells of two fingerprints. Null texts count as
    empty; texts without pieces have an empty sketch, alike to another such one. doc_ids are of any type that has an order. Rows may
    repeat; extra columns are ignored; an empty table gives an empty result.
    """
    if dict(docs.dtypes)["doc_id"] not in WHOLE:
        numbered, ids = numbered_ids(docs.select("doc_id", "text"), "next-places")
        return named_ids(fingerprints(numbered), ids, "doc_id")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.substring("text", 1, F.length("text") - half), F.substring("following", 1, half)))
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "pieces", "following_pieces", digests(F.col("edited")).alias("edited_pieces"))
    rows = with_sketches(rows, "pieces", "edited_pieces", "following_pieces")
    for c in ("edited", "following"):
        rows = with_difference(rows, "pieces", f"{c}_pieces", f"from_{c}")
    near = lambda c: likeness(F.size("pieces"), F.size(f"{c}_pieces"), F.col(f"from_{c}"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", encoded(F.size("pieces"), F.col("pieces_cells")).alias("fingerprint"),
        encoded(F.size("edited_pieces"), F.col("edited_pieces_cells")).alias("edited_fingerprint"), near("edited").alias("near_edited"), near("following").alias("near_next"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: fingerprints of all documents, of their edited texts, and their likeness."""
    return fingerprints(documents(spark, sf_dir))
