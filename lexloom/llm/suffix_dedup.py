"""Removal of passages that repeat across documents: prefix-free parsing, with suffix arrays over the dictionary of phrases.

Triggers. Every span of bytes (50 by default) is one window, and its trigger is the 32-byte string in it with the least rolling hash, which
depends on the window's bytes alone. Windows in a row with one trigger form a phrase: the bytes that they cover together. Phrases overlap
by all but one byte of a window, so each window lies in exactly one phrase, and equal windows have equal triggers.

Parse and dictionary. Texts lie in chunks of bounded size. A chunk sends the distinct hashes of its triggers to buckets, which answer which
triggers other documents hold, too; most phrases of plain prose end there. The phrases of the others enter the dictionary: buckets answer
in which document each phrase comes first. A phrase of a later document is a repeat as a whole, however often it occurs, and takes no
further part; in repetitive text that is nearly all.

Corpus order. What is left is each distinct phrase once, with its bytes, by its trigger. A bucket sorts the suffixes of its phrases (those
of at least a window, up to that length): neighbours with a common prefix of a window are equal windows, and all but those of the first
document in that order are repeats. A trigger in very many chunks sends its windows one by one, by their own hash, so it fills no bucket.

Only hashes of triggers and whole phrases stand for bytes; a trigger's hash only widens the search. Sending one hash for each chunk and
distinct phrase also bounds what a passage in a third of all documents costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPAN = 50
#: Length of a trigger, as a share of a window.
TRIGGER = 0.64
#: Bytes of text in a chunk, and hashed at once, about; a longer text is alone in either.
CHUNK_BYTES, PIECE_BYTES = 4 << 20, 1 << 18
#: Hashes that a bucket should get, about.
BUCKET_ENTRIES = 1 << 20
#: A trigger in more chunks than that sends its windows apart.
HOT_CHUNKS = 64
SEED = 0x5AFF1C

_rng = np.random.default_rng(SEED)
_BYTE = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_u = np.uint64


def packed(body: bytes) -> bytes:
    """Texts move between tasks compressed; Spark's own codec for that leaves them a good deal larger."""
    return pa.Codec("zstd").compress(body, asbytes=True) if body else b""


def unpacked(body: pa.Buffer | bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(body, size) if size else b"", np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def rolling(body: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each string of width bytes, built from those of half the length."""
    h, k, level = _BYTE[body], 1, 0
    while 2 * k <= width:
        h = (h[:-k] ^ (h[:-k] >> _u(31))) * _FACTORS[level] + h[k:]
        k, level = 2 * k, level + 1
    if rest := width - k:
        h = (h[:-rest] ^ (h[:-rest] >> _u(31))) * _FACTORS[level] + h[rest:]
    return _mixed(h)


def lengths(span: int) -> tuple[int, int]:
    """Of a trigger, and the number of triggers in a window."""
    width = min(span, max(span - 120, int(TRIGGER * span + 0.5), (span + 1) // 2))
    return width, span - width + 1


def _parsed(body: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    width, reach = lengths(span)
    none = np.zeros(0, np.int64)
    if len(body) < span:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    g = rolling(body, width)
    low = _u(7)
    v, k = g >> low << low, 1  # the low bits tell how far ahead the least hash lies
    while 2 * k <= reach:
        v = np.minimum(v[:-k], v[k:] + _u(k))
        k *= 2
    if rest := reach - k:
        v = np.minimum(v[:-rest], v[rest:] + _u(rest))
    cut = np.zeros(len(body) + 1, np.int8 if len(ends) < 100 else np.int32)
    starts = np.concatenate(([0], ends[:-1]))
    np.add.at(cut, np.maximum(starts, ends - span + 1), 1)
    np.add.at(cut, ends, -1)
    s = np.flatnonzero(np.cumsum(cut[:-1])[: len(v)] == 0)  # windows within one document
    if not len(s):
        return none, none, none.view(np.uint64), none.view(np.uint64)
    at = s + (v[s] & _u(127)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1))))
    a, b = s[new], s[np.concatenate((new[1:], [len(s)])) - 1]
    h = _mixed(g[at[new]] ^ _u(0x9E3779B97F4A7C15))
    x = _mixed(g[a] * _FACTORS[9] + g[a + reach - 1] * _FACTORS[10] + g[b + reach - 1] * _FACTORS[11] + (b - a).astype(np.uint64))
    return a, b, h, x


def phrases(body: np.ndarray, ends: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """a, b, h, x of each phrase of the documents in body that end at ends: its first and last window, hashes of its trigger and of its bytes."""
    out, start, i = [], 0, 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, start + PIECE_BYTES, "right")))
        stop = int(ends[j - 1])
        if stop - start <= 2 * PIECE_BYTES:
            pieces = [(start, stop, ends[i:j] - start)]
        else:  # a long text: a phrase may end where a piece does, but each window still lies in one
            cuts = range(start, max(start + 1, stop - span + 1), PIECE_BYTES)
            pieces = [(c, min(stop, c + PIECE_BYTES + span - 1), np.array([min(stop - c, PIECE_BYTES + span - 1)])) for c in cuts]
        for c, e, own in pieces:
            a, b, h, x = _parsed(body[c:e], own, span)
            out.append((a + c, b + c, h, x))
        start, i = stop, j
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64 if k < 2 else np.uint64) for k in range(4))


def window_hashes(body: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """A hash of each window that starts at one of at, in one run of bytes."""
    width, reach = lengths(span)
    g = rolling(body, width)
    return _mixed(g[at] * _FACTORS[12] + g[at + reach - 1] * _FACTORS[13])


def suffix_order(body: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of body that start at one of at, sorted by their first span bytes, and where in that order such a prefix differs from the one before."""
    padded = np.zeros((len(at), -(-span // 8) * 8), np.uint8)
    padded[:, :span] = body[at[:, None] + np.arange(span)[None, :]]
    words = padded.view(">u8")
    order = np.lexsort(words.T[::-1])
    words = words[order]
    return order, np.concatenate(([True], (words[1:] != words[:-1]).any(axis=1)))[: len(at)]


def repeats(body: np.ndarray, at: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
    """Which windows of a bucket (with their documents' places in the order) also start in a document before."""
    out = np.zeros(len(at), bool)
    if not len(at):
        return out

    def late(groups: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Per row of some, sorted by groups (True where one begins), whether a row of its group has a smaller order; and whether any of the group has."""
        first = np.flatnonzero(groups)
        sizes = np.diff(np.concatenate((first, [len(some)])))
        return np.repeat(np.minimum.reduceat(order[some], first), sizes), np.repeat(np.maximum.reduceat(order[some], first), sizes)

    w = window_hashes(body, at, span)
    some = np.argsort(w, kind="stable")
    least, most = late(np.concatenate(([True], w[some][1:] != w[some][:-1])), some)
    some = np.sort(some[least < most])  # only windows whose hash two documents hold are sorted as suffixes
    for i in _cuts(w, some):
        place, groups = suffix_order(body, at[i], span)
        least, _ = late(groups, i[place])
        out[i[place]] = order[i[place]] > least
    return out


def _cuts(w: np.ndarray, some: np.ndarray, most: int = 1 << 19) -> Iterator[np.ndarray]:
    """Parts of some by hash, so that equal windows stay together and sorting takes bounded memory."""
    parts = -(-len(some) // most)
    turn = (w[some] >> _u(3)) % _u(max(1, parts))
    for p in range(parts):
        yield some[turn == p]


def _ordered(docs: DataFrame) -> tuple[DataFrame, str]:
    """doc_id, place (a bigint in the order of doc_ids, null last), text."""
    kind = dict(docs.dtypes)["doc_id"]
    text = common.text_or_empty().cast("binary").alias("text")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("place"), text), kind
    ids = docs.select(F.col("doc_id").alias("_id")).filter("_id IS NOT NULL").distinct().orderBy("_id")
    ids = common.materialize(ids.select("_id", F.monotonically_increasing_id().alias("place")), "suffix-places")
    return docs.join(ids, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.coalesce("place", F.lit((1 << 63) - 1)).alias("place"), text), kind


def _chunks(docs: DataFrame) -> tuple[DataFrame, str]:
    """chunk, doc_ids, places, sizes, body (packed): the documents in rows of bounded size, as they lie in the input."""
    rows, kind = _ordered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn, held, size = TaskContext.get().partitionId() << 33, 0, [], 0

        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), c)
            ids, places, texts = (table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0) for c in ("doc_id", "place", "text"))
            sizes = pc.binary_length(texts).cast(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([part + turn], pa.int64()), one(ids), one(places), one(sizes), pa.array([packed(b"".join(texts.to_pylist()))], pa.binary())], ["chunk", "doc_ids", "places", "sizes", "body"])

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES - size, "right")))
                held.append(batch.slice(start, end - start))
                size += int(ends[end - 1]) - before
                start = end
                if size >= CHUNK_BYTES or start < batch.num_rows:
                    yield made(held)
                    held, size, turn = [], 0, turn + 1
        if held:
            yield made(held)

    shape = f"chunk bigint, doc_ids array<{kind}>, places array<bigint>, sizes array<bigint>, body binary"
    return common.materialize(rows.mapInArrow(run, shape), "suffix-chunks"), kind


class _Chunk:
    """A chunk's phrases, and what buckets have answered about them."""

    def __init__(self, batch: pa.RecordBatch, i: int, span: int, bits: int) -> None:
        col = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
        self.id, self.bits, self.span = col["chunk"].as_py(), bits, span
        self.ends = np.cumsum(col["sizes"].values.to_numpy())
        self.body = unpacked(col["body"].as_buffer(), int(self.ends[-1]))
        places = col["places"].values.to_numpy()
        self.a, self.b, self.h, self.x = phrases(self.body, self.ends, span)
        self.place = places[np.searchsorted(self.ends, self.a, "right")]
        # Trigger hashes as buckets' bits and 31 more.
        self.keys, self.of_key = np.unique(self.h >> _u(33 - bits), return_inverse=True)

    def flags(self, answers: list[dict]) -> np.ndarray:
        """Of each phrase: 0 if no other document has its trigger, 2 if very many chunks have, else 1."""
        return np.frombuffer(b"".join(r["answer"] for r in sorted(answers, key=lambda r: r["bucket"])), np.uint8)[self.of_key]

    def dictionary(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the phrases some: their distinct hashes in order, the index of each one's hash, and the least place of each hash."""
        keys, of = np.unique(self.x[some], return_inverse=True)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, of, self.place[some])
        return keys, of, least


def _rows_of(chunk: int, buckets: np.ndarray, *columns: np.ndarray) -> tuple[list, ...]:
    """One row for each run of equal buckets: bucket, chunk, and the bytes of the columns."""
    first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(buckets) else np.zeros(0, np.int64)
    ends = [*first[1:], len(buckets)][: len(first)]
    return [int(buckets[i]) for i in first], [chunk] * len(first), *[[c[i:j].tobytes() for i, j in zip(first, ends, strict=True)] for c in columns]


def _trigger_entries(span: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _Chunk(batch, i, span, bits)
                least, most = np.full(len(c.keys), np.iinfo(np.int64).max), np.full(len(c.keys), np.iinfo(np.int64).min)
                np.minimum.at(least, c.of_key, c.place)
                np.maximum.at(most, c.of_key, c.place)
                entry = ((c.keys & _u(0x7FFFFFFF)) << _u(1) | (least < most).astype(np.uint64)).astype("<u4")
                out = _rows_of(c.id, (c.keys >> _u(31)).astype(np.int64), entry)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["bucket", "chunk", "entries"])

    return run


def _answers(sizes: list[int], values: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [values[e - n : e].tobytes() for n, e in zip(sizes, ends, strict=True)]


def _trigger_answers(table: pa.Table) -> pa.Table:
    """Which triggers of a bucket several documents hold (1), or very many chunks (2)."""
    entries = [np.frombuffer(x, "<u4") for x in table["entries"].to_pylist()]
    every = np.concatenate(entries)
    keys, of, n = np.unique(every >> 1, return_inverse=True, return_counts=True)
    several = np.zeros(len(keys), bool)
    several[of[(every & 1) == 1]] = True
    flag = np.where(n > HOT_CHUNKS, 2, np.where((n > 1) | several, 1, 0)).astype(np.uint8)[of]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "answer": pa.array(_answers([len(e) for e in entries], flag), pa.binary())})


def _phrase_entries(span: int, bits: int, base: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _Chunk(batch, i, span, bits)
                if len(c.a):
                    keys, _, least = c.dictionary(np.flatnonzero(c.flags(batch.column("triggers")[i].as_py())))
                    out = _rows_of(c.id, (keys >> _u(64 - bits)).astype(np.int64), keys, (least - base).astype(kind))
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["bucket", "chunk", "entries", "places"])

    return run


def _phrase_answers(kind: str):
    def run(table: pa.Table) -> pa.Table:
        """The first place of each phrase of a bucket, among all chunks."""
        entries = [np.frombuffer(x, np.uint64) for x in table["entries"].to_pylist()]
        places = np.concatenate([np.frombuffer(x, kind) for x in table["places"].to_pylist()])
        keys, of = np.unique(np.concatenate(entries), return_inverse=True)
        least = np.full(len(keys), np.iinfo(np.dtype(kind)).max, kind)
        np.minimum.at(least, of, places)
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "answer": pa.array(_answers([len(e) for e in entries], least[of]), pa.binary())})

    return run


_OPEN = "kind int, bucket bigint, chunk bigint, p binary, q binary, r binary, s binary, body binary"


def _open_phrases(span: int, bits: int, base: int, kind: str):
    """Rows of kind 0, one a chunk: p, q: runs of windows that are repeats as whole phrases; r, s: the first windows of the phrases that stay open, with their numbers.

    Rows of kind 1, one a chunk and bucket: p: numbers of open phrases, q: their first window here and how many follow, r: places, body: the bytes (packed).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _OPEN.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        for batch in batches:
            for i in range(batch.num_rows):
                c = _Chunk(batch, i, span, bits)
                if not len(c.a):
                    continue
                flags = c.flags(batch.column("triggers")[i].as_py())
                some = np.flatnonzero(flags)
                keys, of, least = c.dictionary(some)
                told = sorted(batch.column("phrases")[i].as_py() or [], key=lambda r: r["bucket"])
                least = np.minimum(least, np.frombuffer(b"".join(r["answer"] for r in told), kind).astype(np.int64) + base)
                whole = c.place[some] > least[of]
                one = some[whole]
                new = np.flatnonzero(np.concatenate(([True], c.a[one][1:] != c.b[one][:-1] + 1)))[: len(one)]
                last = np.concatenate((new[1:], [len(one)]))[: len(new)] - 1
                left, number = some[~whole], of[~whole]
                rows = [(0, 0, c.id, c.a[one][new].tobytes(), c.b[one][last].tobytes(), c.a[left].tobytes(), number.astype(np.int64).tobytes(), b"")]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                number, at = np.unique(number, return_index=True)
                left = left[at]
                hot = flags[left] == 2
                n = (c.b - c.a + 1)[left]
                # Phrases of hot triggers go window by window.
                times = np.where(hot, n, 1)
                row = np.repeat(np.arange(len(left)), times)
                shift = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                n = np.where(hot[row], 1, n[row])
                start = c.a[left][row] + shift
                key = c.h[left][row]
                if hot.any():
                    key[hot[row]] = window_hashes(c.body, start[hot[row]], span)
                bucket = (key >> _u(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, row, shift, n, start = bucket[order], row[order], shift[order], n[order], start[order]
                ends = np.cumsum(n + span - 1)
                body = c.body[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - (n + span - 1)), n + span - 1)]
                first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[: len(bucket)]
                stops = [*first[1:], len(bucket)][: len(first)]
                cols = (number[row].astype("<u4"), (shift << 8 | n).astype("<u2"), (least[number[row]] - base).astype(kind))
                rows = [(1, int(bucket[f]), c.id, *[x[f:e].tobytes() for x in cols], b"", packed(body[ends[f] - n[f] - span + 1 : ends[e - 1]].tobytes())) for f, e in zip(first, stops, strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _window_answers(span: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        """The windows of a bucket's phrases that a document before has, too: per chunk, phrase number << 8 | window of the phrase."""
        number, shape, place = (np.concatenate([np.frombuffer(x, k) for x in table[c].to_pylist()]) for c, k in (("p", "<u4"), ("q", "<u2"), ("r", kind)))
        n, shift = (shape & 255).astype(np.int64), (shape >> 8).astype(np.int64)
        sizes = [len(x) // 4 for x in table["p"].to_pylist()]
        bytes_ = np.add.reduceat(n + span - 1, np.cumsum([0, *sizes[:-1]]))  # no row is empty
        body = np.concatenate([unpacked(x, int(k)) for x, k in zip(table["body"].to_pylist(), bytes_, strict=True)])
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begins = np.cumsum(n + span - 1) - (n + span - 1)
        hit = np.flatnonzero(repeats(body, begins[row] + within, place[row].astype(np.int64), span)) if len(row) else np.zeros(0, np.int64)
        code = number[row[hit]].astype(np.int64) << 8 | (shift[row[hit]] + within[hit])
        owner = chunk[row[hit]]
        chunks = table["chunk"].to_pylist()
        held = [(k, code[owner == k]) for k in np.unique(owner)]
        return pa.table({"chunk": pa.array([chunks[k] for k, _ in held], pa.int64()), "bucket": pa.array([0] * len(held), pa.int64()), "answer": pa.array([x.tobytes() for _, x in held], pa.binary())})

    return run


def _removed(span: int, kind: pa.DataType | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                col = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                ends = np.cumsum(col["sizes"].values.to_numpy())
                body = unpacked(col["body"].as_buffer(), int(ends[-1]))
                starts = np.concatenate(([0], ends[:-1]))
                edge = np.zeros(len(body) + 1, np.int32)
                number = lambda name, col=col: np.frombuffer(col[name].as_py() or b"", np.int64)
                np.add.at(edge, number("p"), 1)
                np.add.at(edge, number("q") + span, -1)
                if hits := col["windows"].as_py():
                    hits = np.frombuffer(b"".join(hits), np.int64)
                    first, phrase = number("r"), number("s")
                    order = np.argsort(phrase, kind="stable")
                    low, high = (np.searchsorted(phrase[order], hits >> 8, side) for side in ("left", "right"))
                    times = high - low
                    which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    at = first[order][which] + np.repeat(hits & 255, times)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + span, -1)
                gone = np.cumsum(edge[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                begins[starts[starts < len(body)]] = gone[starts[starts < len(body)]]
                stops = gone.copy()
                stops[:-1] &= ~gone[1:]
                full = ends[ends > starts] - 1
                stops[full] = gone[full]
                begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
                doc = np.searchsorted(ends, begin, "right")
                count = np.searchsorted(doc, np.arange(len(ends) + 1))
                spans = pa.StructArray.from_arrays([pa.array(begin - starts[doc], pa.int64()), pa.array(stop - starts[doc], pa.int64())], ["start", "end"])
                kept = [body[s:e].tobytes() if not m else body[s:e][~gone[s:e]].tobytes() for s, e, m in zip(starts, ends, np.diff(count), strict=True)]
                step = 512
                ids, sizes, spans = col["doc_ids"].values, col["sizes"].values, pa.ListArray.from_arrays(pa.array(count, pa.int32()), spans)
                for k in range(0, len(ends), step):
                    yield pa.RecordBatch.from_arrays([ids.slice(k, step), sizes.slice(k, step), spans.slice(k, step), pa.array(kept[k : k + step], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end in bytes), kept (binary) for each row of docs (doc_id, text; other columns are ignored).

    Removed is each byte of a text in UTF-8 that a string of span bytes (at most 255) covers which also starts in a document with a smaller
    doc_id; strings are judged on the input, so what is removed can still be the first copy for others. spans are maximal. A null text is
    empty. doc_ids are of any type that has an order; a null one counts as larger than all others, and rows that share a doc_id take
    nothing from each other. Texts shorter than span stay whole. An empty table gives an empty result.
    """
    if not 8 <= span <= 255:
        raise ValueError("span must be from 8 to 255 bytes")
    spark = docs.sparkSession
    chunks, kind = _chunks(docs)
    total, low, high = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.min(F.array_min("places")), F.max(F.array_max("places"))).first()
    shape = f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    if total is None:
        return spark.createDataFrame([], shape)
    # Places fit in four bytes where doc_ids lie close together.
    base, numbers = (low, "<u4") if high - low < 2**32 - 1 else (0, "<i8")
    bits = int(np.clip(np.ceil(np.log2(max(1, total / lengths(span)[1] * 2 / BUCKET_ENTRIES))), 3, 24))

    def told(entries: DataFrame, answer, label: str, name: str) -> DataFrame:
        answers = entries.groupBy("bucket").applyInArrow(answer, "chunk bigint, bucket bigint, answer binary")
        with common.shuffles_removed(spark):  # each exchange is about as large as the input
            return common.materialize(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias(name)), label)

    entries = chunks.mapInArrow(_trigger_entries(span, bits), "bucket bigint, chunk bigint, entries binary")
    triggers = told(entries, _trigger_answers, "suffix-triggers", "triggers")
    asked = chunks.join(triggers, "chunk")
    entries = asked.mapInArrow(_phrase_entries(span, bits, base, numbers), "bucket bigint, chunk bigint, entries binary, places binary")
    first = told(entries, _phrase_answers(numbers), "suffix-phrases", "phrases")
    with common.shuffles_removed(spark):
        left = common.materialize(asked.join(first, "chunk").mapInArrow(_open_phrases(span, bits, base, numbers), _OPEN), "suffix-open")
    windows = told(left.filter("kind = 1"), _window_answers(span, numbers), "suffix-windows", "windows")
    marks = left.filter("kind = 0").select("chunk", "p", "q", "r", "s").join(windows.select("chunk", F.transform("windows", lambda w: w["answer"]).alias("windows")), "chunk", "left")
    return chunks.drop("places").join(marks, "chunk", "left").mapInArrow(_removed(span), shape)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents without the strings of 50 bytes that an earlier one has."""
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return without_repeats(common.documents(spark, sf_dir)).select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB looks at every string of 50 bytes, written in hexadecimal digits.
OP12_SQL = """WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pieces AS MATERIALIZED (SELECT doc_id, p, x[2 * p + 1 : 2 * p + 1122] AS y FROM texts, range(0, len(x) // 2, 512) r(p)),
windows AS MATERIALIZED (SELECT doc_id, p + i AS i, md5_number(y[2 * i + 1 : 2 * i + 100]) AS w FROM pieces, range(0, least(512, len(y) // 2 - 49)) q(i)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE doc_id > first),
ends AS (SELECT doc_id, i, coalesce(i > lag(i) OVER w + 50, true) AS new FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, min(i) AS start, max(i) + 50 AS stop FROM (SELECT doc_id, i, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM ends) GROUP BY doc_id, run),
gone AS (SELECT doc_id, sum(stop - start)::BIGINT AS n_removed, count(*) AS n_spans, list(stop ORDER BY start) AS stops, list(start ORDER BY start) AS starts FROM runs GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(CASE WHEN starts IS NULL THEN x ELSE array_to_string(list_transform(list_zip(list_prepend(0, stops), list_append(starts, len(x) // 2)), lambda z: x[2 * z[1] + 1 : 2 * z[2]]), '') END)) AS kept_sha256
FROM texts LEFT JOIN gone USING (doc_id)"""
