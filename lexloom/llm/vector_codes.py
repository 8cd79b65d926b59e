"""Vector code compression: product codes of integer vectors, codebooks fitted by Lloyd rounds that skip by Hamerly's bounds.

A vector is cut into parts, and each part position has a codebook. Beside its entry's index a part keeps two bounds from round to round: an
upper one on the distance to its entry and a lower one on the distance to any other. When entries move, the upper bound grows by its entry's
move and the lower one shrinks by the largest other move. As long as the upper bound is strictly below the lower one (or below half the
distance from its entry to the next), no other entry can be as near, so the index stays. Else the upper bound is made exact, and if that
doesn't help the part is compared with all entries in whole numbers; ties go to the lower index. Bounds are rounded outwards, so they decide
nothing that integers would decide otherwise.

State (components, indexes, bounds) lies in a table of the shared folder that each round writes anew. A round sums up only parts whose index
has changed, within a task, then over tasks by Spark; what the driver sees are the sums of the codebook's entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vectors import embeddings, lists, matrix, measured, usable, whole

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: By how much bounds are rounded outwards; far more than what floating point loses in them.
SLACK = 1e-12
#: A squared distance beyond any other, where there is no other entry.
FAR = 1e300
#: Parts that are compared with all entries at once.
BLOCK = 1024

_STATE = "v array<int>, code binary, old binary, upper array<double>, lower array<double>"


def _up(x):
    return np.sqrt(x) * (1 + SLACK)


def _down(x):
    return np.sqrt(x) * (1 - SLACK)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry's index of each row, and the whole squared distances to it and to the nearest other entry (FAR if there is none)."""
    exact = x.shape[1] * (2 * float(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))) ** 2 < 2**52
    kind = np.float64 if exact else np.int64  # products of whole numbers below 2**53 are exact in either
    c = book.astype(kind)
    square = (c * c).sum(axis=1)
    code, first, second = np.empty(len(x), np.uint8), np.empty(len(x)), np.full(len(x), FAR)
    for i in range(0, len(x), BLOCK):
        some = x[i : i + BLOCK].astype(kind)
        d = (some * some).sum(axis=1)[:, None] - 2 * (some @ c.T) + square[None, :]
        at = d.argmin(axis=1)
        rows = np.arange(len(some))
        code[i : i + BLOCK], first[i : i + BLOCK] = at, d[rows, at]
        if len(book) > 1:
            rest = d.astype(np.float64)
            rest[rows, at] = FAR
            second[i : i + BLOCK] = rest.min(axis=1)
    return code, first, second


class Moves:
    """What a change of one part position's codebook does to bounds."""

    def __init__(self, old: np.ndarray, new: np.ndarray) -> None:
        self.by = _up(((new - old).astype(np.float64) ** 2).sum(axis=1))
        top = np.argsort(-self.by, kind="stable")
        self.others = np.full(len(new), self.by[top[0]])
        self.others[top[0]] = self.by[top[1]] if len(new) > 1 else 0.0
        gaps = ((new[:, None, :] - new[None, :, :]).astype(np.float64) ** 2).sum(axis=2)
        np.fill_diagonal(gaps, FAR)
        self.half = _down(gaps.min(axis=1)) / 2


def reassigned(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moves: Moves) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Indexes and bounds of the rows of one part position after its codebook has moved, and the number of rows compared with all entries."""
    upper = (upper + moves.by[code]) * (1 + SLACK)
    lower = lower - moves.others[code] - SLACK * (np.abs(lower) + moves.others[code])
    safe = np.maximum(lower, moves.half[code])
    code = code.copy()
    open_ = np.flatnonzero(~(upper < safe))
    if len(open_):
        off = x[open_] - book[code[open_]]
        upper[open_] = _up((off * off).sum(axis=1))
        open_ = open_[~(upper[open_] < safe[open_])]
    if len(open_):
        code[open_], first, second = scan(x[open_], book)
        upper[open_], lower[open_] = _up(first), _down(second)
    return code, upper, lower, len(open_)


def _columns(width: int, parts: int, ids: list[pa.Array], x: np.ndarray, code: np.ndarray, old: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> list[pa.Array]:
    raw = lambda a: pa.array([bytes(r) for r in a], pa.binary())
    return [*ids, lists(x.astype(np.int32), pa.int32()), raw(code), raw(old), lists(upper, pa.float64()), lists(lower, pa.float64())]


def _first_pass(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), parts * width)
            code, upper, lower = np.empty((len(x), parts), np.uint8), np.empty((len(x), parts)), np.empty((len(x), parts))
            for p in range(parts):
                code[:, p], first, second = scan(x[:, p * width : (p + 1) * width], books[p])
                upper[:, p], lower[:, p] = _up(first), _down(second)
            yield pa.RecordBatch.from_arrays(_columns(width, parts, [batch.column(0), batch.column(1)], x, code, code, upper, lower), ["vec_id", "label", "v", "code", "old", "upper", "lower"])

    return run


def _next_pass(old_books: np.ndarray, books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = [Moves(old_books[p], books[p]) for p in range(parts)]
        for batch in batches:
            x = matrix(batch.column(2), parts * width)
            before = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(x), parts)
            upper, lower = (batch.column(i).flatten().to_numpy().reshape(len(x), parts).copy() for i in (5, 6))
            code = before.copy()
            for p in range(parts):
                code[:, p], upper[:, p], lower[:, p], _ = reassigned(x[:, p * width : (p + 1) * width], books[p], before[:, p], upper[:, p], lower[:, p], moves[p])
            yield pa.RecordBatch.from_arrays(_columns(width, parts, [batch.column(0), batch.column(1)], x, code, before, upper, lower), ["vec_id", "label", "v", "code", "old", "upper", "lower"])

    return run


def _changes(state: DataFrame, parts: int, entries: int, width: int, first: bool) -> np.ndarray:
    """By how much the sums (and, last, the counts) of each entry change, as whole numbers of any size: [part, entry, component]."""
    slots = width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, slots), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), parts * width)
            new, old = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(len(x), parts) for i in (1, 2))
            for p in range(parts):
                moved = np.ones(len(x), bool) if first else new[:, p] != old[:, p]
                part = np.concatenate([x[moved, p * width : (p + 1) * width], np.ones((int(moved.sum()), 1), np.int64)], axis=1)
                np.add.at(sums[p], new[moved, p], part)
                if not first:
                    np.subtract.at(sums[p], old[moved, p], part)
        flat = sums.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at])], ["slot", "total"])

    rows = state if first else state.filter("code <> old")
    out = np.zeros(parts * entries * slots, object)
    for r in rows.select("v", "code", "old").mapInArrow(run, "slot int, total bigint").groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # at most one row per number of the codebooks
        out[r["slot"]] = int(r["total"])
    return out.reshape(parts, entries, slots)


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """For each row of rows (vec_id, embedding, label; other columns are ignored) with a usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are left out. Components become floor(scale * x). Vectors are cut
    into equal consecutive parts; a vector that is shorter than the longest, or than a multiple of parts, counts as filled up with zeros.
    Each part position's codebook starts as that part of the rows with the entries smallest vec_ids (null last, ties by components);
    with fewer rows there are fewer entries. vec_ids may repeat and be null, and rows stay apart. label_error sums up error over equal
    labels, nulls together. error is a bigint; components too large for that are an error, which names the limit. An empty table, or one
    without usable vectors, gives an empty result.
    """
    spark = rows.sparkSession
    kept = rows.filter(usable()).select("vec_id", "label", "embedding")
    n, width, most = measured(kept, "embedding", scale)
    kinds = dict(kept.dtypes)
    if not n:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    width = max(1, -(-width // parts))
    if width * parts * (2 * most) ** 2 >= 2**62 or most >= 2**30:
        raise ValueError(f"components times {scale} must be below {min(2**30, int((2**62 / (width * parts)) ** 0.5 / 2))}, as errors are 64-bit numbers")
    whole_rows = kept.select("vec_id", "label", whole("embedding", scale).alias("v"))
    first = whole_rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(min(entries, 256)).collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["v"])] = r["v"]
    books = np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2))
    shape = f"vec_id {kinds['vec_id']}, label {kinds['label']}, {_STATE}"
    state, path = common.materialize_only(lambda: whole_rows.mapInArrow(_first_pass(books), shape), spark, "codes-0")
    totals = np.zeros((parts, len(first), width + 1), object)
    for k in range(rounds):
        totals = totals + _changes(state, parts, len(first), width, not k)
        new = books.copy()
        for p, e in zip(*np.nonzero(totals[:, :, -1]), strict=True):
            new[p, e] = [int(s) // int(totals[p, e, -1]) for s in totals[p, e, :-1]]
        last = path
        state, path = common.materialize_only(lambda was=books, now=new, state=state: state.mapInArrow(_next_pass(was, now), shape), spark, f"codes-{k + 1}")
        common.remove(spark, [last])
        books = new
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), parts * width).reshape(-1, parts, width)
            code = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(x), parts)
            off = x - np.stack([books[p][code[:, p]] for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bytes(r).hex() for r in code], pa.string()), pa.array((off * off).sum(axis=(1, 2)), pa.int64())], ["vec_id", "label", "code", "error"])

    coded = state.mapInArrow(ended, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")
    coded = common.materialize(coded, "codes")
    sums = common.materialize(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "code-errors")
    joined = coded.join(common.small(sums, 32), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: codes of all embeddings, with codebooks of 256 entries for each of four parts after four rounds."""
    return vector_codes(embeddings(spark, sf_dir))


def _sql() -> str:
    """Lloyd's rounds spelt out, with every distance computed."""
    out = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) r(p))",
        "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))",
    ]
    near = "SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 256 + j) AS best FROM parts JOIN b{k} USING (p) GROUP BY vec_id, p"
    for k in range(ROUNDS):
        out += [
            f"a{k} AS MATERIALIZED ({near.format(k=k)})",
            f"s{k} AS (SELECT p, best % 256 AS j, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{k}, range(1, 17) r(i) GROUP BY p, j, i)",
            f"m{k} AS (SELECT p, j, list(m ORDER BY i) AS c FROM s{k} GROUP BY p, j)",
            f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.j = m.j)",
        ]
    out += [
        f"a{ROUNDS} AS MATERIALIZED ({near.format(k=ROUNDS)})",
        f"sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b{ROUNDS})",
        f"coded AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)",
    ]
    return "WITH " + ",\n".join(out) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, sha"


OP13_SQL = _sql()
