"""Mixture-controlled packing: deficit round-robin over source queues fills windows of a fixed length.

Each source is a queue of tokens. In a round, which hands out as many tokens as a window holds, a queue's deficit grows by its target
share, and the queue sends as many whole quanta as its deficit covers; the rest is carried on, across windows and partitions. A queue
that drains leaves the mixture and the others share its part. What the rounds send, in order, is cut into windows. First deficits differ,
so that queues of one size don't send their quanta in the same rounds and a round stays as long as a window.

With more sources than a schedule has queues, rare ones are members of shared queues. A shared queue's own stream is mixed from its members
by the same schedule, and its share of a window is the sum of theirs.

Deficits follow from the round's number alone: after r rounds a queue has sent floor((deficit + r * share) / quantum) quanta. So the
driver works out only the few phases between drains, and each partition places its own documents by arithmetic.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import documents, materialize, running_base, text_or_empty

WINDOW = 2048
#: Small against a queue's part of a window, so that each window holds the targets.
QUANTUM = 16
END_ID = 1
#: Queues of the schedule. Of more sources, the first HEADS have one each, and the others share the rest as members.
QUEUES, HEADS = 255, 128
#: Members that a shared queue has at most. Sources beyond HEADS + (QUEUES - HEADS) * MEMBERS, 65,024, share a member's place.
MEMBERS = 512


@dataclass
class Phase:
    """Rounds between two drains. sent, deficit: of each queue at its start; share: its part of ``shares``, 0 if it has drained."""

    start: int
    rounds: int
    sent: np.ndarray
    deficit: np.ndarray
    share: np.ndarray
    shares: int
    final: np.ndarray


def _scaled(weights: list[int], total: int) -> np.ndarray:
    """Whole-number shares small enough for 64-bit arithmetic on total tokens."""
    most = max(1, (1 << 61) // max(1, total))
    top = sum(weights)
    return np.array([w if top <= most else max(1, w * most // top) for w in weights], np.int64)


def schedule(sizes: list[int], weights: list[int] | None = None, window: int = WINDOW, quantum: int = QUANTUM) -> list[Phase]:
    """sizes: tokens of each queue; weights: its target, its size if None. At most a phase for each queue."""
    total = sum(sizes)
    share = _scaled(weights or sizes, total + window)
    left = np.array(sizes, np.int64)
    share = np.where(left > 0, np.maximum(share, 1), 0)
    deficit, sent, start = np.arange(len(sizes)) * 618 % 1000 * quantum // 1000, np.zeros(len(sizes), np.int64), 0
    phases = []
    while (alive := left > sent).any():
        share = np.where(alive, share, 0)
        shares = int(share.sum())
        rounds = min(max(1, -(-(int(left[i] - sent[i] - deficit[i]) * shares) // (window * int(share[i])))) for i in np.flatnonzero(alive))
        allowed = [int(deficit[i]) * shares + rounds * window * int(share[i]) for i in range(len(sizes))]
        drained = np.array([bool(alive[i]) and allowed[i] >= int(left[i] - sent[i]) * shares for i in range(len(sizes))])
        final = np.array([int(left[i] - sent[i]) if drained[i] else allowed[i] // (quantum * shares) * quantum if alive[i] else 0 for i in range(len(sizes))], np.int64)
        phases.append(Phase(start, rounds, sent.copy(), deficit.copy(), share.copy(), shares, final))
        deficit = np.array([0 if drained[i] or not alive[i] else (allowed[i] - int(final[i]) * shares) // shares for i in range(len(sizes))], np.int64)
        start += int(final.sum())
        sent = sent + final
    return phases


def _sent(p: Phase, rounds: np.ndarray, window: int, quantum: int) -> np.ndarray:
    """Tokens that each queue has sent in the phase's first rounds: a row for each entry of rounds."""
    out = (p.deficit[None, :] * p.shares + rounds[:, None] * (window * p.share[None, :])) // (quantum * p.shares) * quantum
    return np.where(rounds[:, None] >= p.rounds, p.final[None, :], out * (p.share[None, :] > 0))


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For n[i] pieces of each i: the piece's i, and its number among them."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _round_of(p: Phase, token: np.ndarray, queue: np.ndarray, window: int, quantum: int) -> np.ndarray:
    """The round of the phase that sends a token of its queue."""
    need = np.minimum((token // quantum + 1) * quantum, p.final[queue])
    rounds = np.maximum(-(-((need - p.deficit[queue]) * p.shares) // (window * p.share[queue])) - 1, 0)
    return np.minimum(rounds, p.rounds - 1)


def place(phases: list[Phase], queue: np.ndarray, start: np.ndarray, end: np.ndarray, window: int = WINDOW, quantum: int = QUANTUM) -> dict[str, np.ndarray]:
    """Pieces of the documents that hold tokens start to end of their queue: doc (index), offset in doc, length, and place in the stream."""
    found = []
    for p in phases:
        base = p.sent[queue]
        a, b = np.maximum(start, base) - base, np.minimum(end, base + p.final[queue]) - base
        doc = np.flatnonzero(a < b)
        if not len(doc):
            continue
        a, b, q = a[doc], b[doc], queue[doc]
        first, last = _round_of(p, a, q, window, quantum), _round_of(p, b - 1, q, window, quantum)
        fast = window * p.share[q] >= quantum * p.shares  # sends in each round: a piece for each; others have one for each quantum
        at, k = _spread(np.where(fast, last - first, (b - 1) // quantum - a // quantum) + 1)
        own, chunk = q[at], a[at] // quantum + k
        rounds = np.where(fast[at], first[at] + k, _round_of(p, np.minimum(chunk * quantum, b[at] - 1), own, window, quantum))
        left, right = np.where(fast[at], a[at], np.maximum(a[at], chunk * quantum)), np.where(fast[at], b[at], np.minimum(b[at], (chunk + 1) * quantum))
        where = np.empty(len(at), np.int64)
        for i in range(0, len(at), 4096):
            s = slice(i, i + 4096)
            before, after, k = _sent(p, rounds[s], window, quantum), _sent(p, rounds[s] + 1, window, quantum), own[s]
            ahead = np.cumsum(after - before, axis=1) - (after - before)
            row = np.arange(len(k))
            left[s], right[s] = np.maximum(left[s], before[row, k]), np.minimum(right[s], after[row, k])
            where[s] = before.sum(axis=1) + ahead[row, k] + left[s] - before[row, k]
        some = left < right
        found.append((doc[at][some], (left + p.sent[own] - start[doc[at]])[some], (right - left)[some], where[some] + p.start))
    if not found:
        return {k: np.zeros(0, np.int64) for k in ("doc", "offset", "length", "place")}
    doc, offset, length, where = (np.concatenate(x) for x in zip(*found, strict=True))
    at, k = _spread((where + length - 1) // window - where // window + 1)
    cut = np.where(k == 0, 0, (where[at] // window + k) * window - where[at])
    doc, offset, where, length = doc[at], offset[at] + cut, where[at] + cut, np.minimum(length[at], (where[at] // window + k + 1) * window - where[at]) - cut
    order = np.lexsort((offset, doc))
    doc, offset, length, where = doc[order], offset[order], length[order], where[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (where[1:] != where[:-1] + length[:-1]) | (where[1:] % window == 0)
    at = np.flatnonzero(new)
    return {"doc": doc[at], "offset": offset[at], "length": np.add.reduceat(length, at), "place": where[at]}


class Layout:
    """Where the tokens of sources lie in the stream. names: all sources that are told apart, sizes: their tokens, weights: their targets."""

    def __init__(self, sizes: list[int], weights: list[int] | None, window: int = WINDOW, quantum: int = QUANTUM):
        self.window, self.quantum, self.weights, self.sizes = window, quantum, weights, np.array(sizes, np.int64)
        self.groups = QUEUES - HEADS if len(sizes) > QUEUES else 0
        self.heads = HEADS if self.groups else len(sizes)
        outer = [[i] for i in range(self.heads)] + [self.members(g) for g in range(self.groups)]
        self.phases = schedule([int(self.sizes[m].sum()) for m in outer], weights and [sum(weights[i] for i in m) for m in outer], window, quantum)
        self.inner: dict[int, list[Phase]] = {}

    def members(self, group: int) -> list[int]:
        return list(range(self.heads + group, len(self.sizes), self.groups))

    def _inner(self, group: int) -> list[Phase]:
        if group not in self.inner:
            if len(self.inner) >= 16:
                self.inner.clear()
            own = self.members(group)
            self.inner[group] = schedule(self.sizes[own].tolist(), self.weights and [self.weights[i] for i in own], self.window, self.quantum)
        return self.inner[group]

    def place(self, source: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
        """As the function place, for the numbers of sources."""
        if (source < self.heads).all():
            return place(self.phases, source, start, end, self.window, self.quantum)
        big = np.flatnonzero(source < self.heads)
        parts = [(source[big], big, np.zeros(len(big), np.int64), start[big], end[big])]
        group, member = (source - self.heads) % self.groups, (source - self.heads) // self.groups
        for g in np.unique(group[source >= self.heads]):
            own = np.flatnonzero((source >= self.heads) & (group == g))
            got = place(self._inner(int(g)), member[own], start[own], end[own], self.window, self.quantum)
            parts.append((np.full(len(got["doc"]), self.heads + g), own[got["doc"]], got["offset"], got["place"], got["place"] + got["length"]))
        queue, doc, offset, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        got = place(self.phases, queue, a, b, self.window, self.quantum)
        out = {"doc": doc[got["doc"]], "offset": offset[got["doc"]] + got["offset"], "length": got["length"], "place": got["place"]}
        order = np.lexsort((out["offset"], out["doc"]))
        return {k: v[order] for k, v in out.items()}


def tokenized(docs: DataFrame, queues: list[str | None], vocabulary: str = tokens.BYTE_BPE, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, queue, part, start, n, ids: the tokens of each row; start counts those of its queue before it in its partition.

    Sources that queues doesn't list share the places of its last ones.
    """
    number = {name: i for i, name in enumerate(queues)}
    rest = max(1, len(queues) - HEADS)
    shared = lambda name: len(queues) - 1 - zlib.crc32((name or "").encode()) % rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        encoder, part, seen = tokens.tokenizer(vocabulary), TaskContext.get().partitionId(), {}
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                ids = [x + end for x in encoder.encode(some.column(1).to_pylist())]
                own = [number[x] if x in number else shared(x) for x in some.column(2).to_pylist()]
                n, start = [len(x) // width for x in ids], []
                for q, k in zip(own, n, strict=True):
                    start.append(seen.get(q, 0))
                    seen[q] = start[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(own, pa.int32()), pa.array([part] * len(n), pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "queue", "part", "start", "n", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text"), _source(docs).alias("source")).mapInArrow(run, f"doc_id {kind}, queue int, part bigint, start bigint, n bigint, ids binary")


def _source(docs: DataFrame) -> Column:
    return (F.col("source") if "source" in docs.columns else F.lit(None)).cast("string")


def pack(docs: DataFrame, window: int = WINDOW, quantum: int = QUANTUM, weights: dict[str | None, int] | None = None, vocabulary: str = tokens.BYTE_BPE, end_id: int = END_ID) -> DataFrame:
    """Packs the tokens of all rows of docs (doc_id, text, source; other columns are ignored) into sequences of window tokens.

    One row per piece: doc_id, start (its row's tokens before it), length, ids_crc32 (of its ids as little-endian 32-bit numbers),
    doc_tokens (all ids of its row, with the end id), sequence_id, offset. All sequences are full but the last. weights gives target
    proportions by source ("*" for those it doesn't name, 1 if that is missing, too); without it each source's target is its share of
    all tokens, so that all queues last to the end. Sources that weights names, and 65,024 in all, are told apart; rarer ones than
    these share a target. Null and empty texts hold just the end id; null sources, and all rows of docs without the column, are one
    source; rows that repeat a doc_id are packed each for itself; null doc_ids stay null. An empty table gives no rows.
    """
    source, weights = _source(docs).alias("source"), {k: int(v) for k, v in (weights or {}).items()}
    most = HEADS + (QUEUES - HEADS) * MEMBERS
    ranked = docs.select(source).groupBy("source").count().orderBy(F.desc("count"), F.col("source").asc_nulls_first()).limit(most).collect()
    named = [x for x in weights if x != "*"]
    names = list(dict.fromkeys([*named, *(r["source"] for r in ranked)]))[: max(most, len(named))]
    table = materialize(tokenized(docs, names, vocabulary, end_id), "pack-ids", rows=256)
    totals = table.groupBy("queue", "part").agg(F.sum("n").alias("total"))
    base = materialize(running_base(totals, "part", "total", "base", ["queue"]).select("queue", "part", "base", "total"), "pack-base")
    sizes = [0] * len(names)
    for r in base.groupBy("queue").agg(F.sum("total").alias("total")).collect():  # at most a row for each name
        sizes[r["queue"]] = r["total"]
    layout = Layout(sizes, [weights.get(x, weights.get("*", 1)) for x in names] if weights else None, window, quantum)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                queue, start, n = (some.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3))
                got = layout.place(queue, start, start + n)
                texts = [memoryview(np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes()) for x in some.column(4)] if wide else [memoryview(x.as_buffer()) for x in some.column(4)]
                crc = [zlib.crc32(texts[d][4 * o : 4 * (o + k)]) for d, o, k in zip(got["doc"].tolist(), got["offset"].tolist(), got["length"].tolist(), strict=True)]
                doc = pa.array(got["doc"])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(doc), pa.array(got["offset"]), pa.array(got["length"]), pa.array(crc, pa.int64()), pa.array(n[got["doc"]]), pa.array(got["place"] // window), pa.array(got["place"] % window)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    wide = tokens.tokenizer(vocabulary).dtype.itemsize == 2
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = table.join(base.select("queue", "part", "base"), ["queue", "part"]).select("doc_id", "queue", (F.col("start") + F.col("base")).alias("start"), "n", "ids")
    return placed.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents in sequences of 2048 tokens."""
    return pack(documents(spark, sf_dir))
