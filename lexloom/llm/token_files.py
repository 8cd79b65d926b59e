"""Token files of directly addressable codes: any token of a file can be read without decoding others.

A number is cut into chunks of 8 bits, lowest first. Level k holds the k-th chunks of all numbers that have one, one byte each. Each
level but the last has a bitmap with a bit per chunk that is set if the number goes on in the next level, and a rank directory: the
set bits before every 512th. A number's chunk on level k + 1 is at the rank of its bit on level k.

Layout of a file: ``DAC2``, tokens and texts (u64 each, big-endian, so that SQL can read them), then, all little-endian, the end of each text
(u64 each, counted in tokens), levels (u32), and for each level: chunks (u64), the chunks, bitmap (bytes to a multiple of 64), directory
(u64 each).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import documents, materialize, running_base, text_or_empty

STEP = 512
END_ID = 2
#: Tokens after which a partition begins a new file.
FILE_TOKENS = 1 << 18


def encode(ids: np.ndarray, lengths: list[int] | None = None) -> bytes:
    """ids: unsigned numbers of up to 32 bits; lengths: how many of them each text has (one text if None)."""
    ends = np.cumsum([len(ids)] if lengths is None else lengths, dtype="<u8")
    head = b"DAC2" + struct.pack(">QQ", len(ids), len(ends)) + ends.tobytes()
    parts, rest, levels = [], ids.astype(np.uint32), 0
    while True:
        more = rest > 0xFF
        levels += 1
        parts += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes()]
        bits = np.zeros(-(-len(rest) // STEP) * STEP, bool)
        bits[: len(rest)] = more
        counts = bits.reshape(-1, STEP).sum(axis=1)
        parts += [np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(counts) - counts).astype("<u8").tobytes()]
        if not more.any():
            return head + struct.pack("<I", levels) + b"".join(parts)
        rest = rest[more] >> 8


class Reader:
    """Random access to the tokens of a file."""

    def __init__(self, data: bytes | memoryview):
        view = memoryview(data)
        if bytes(view[:4]) != b"DAC2":
            raise ValueError("not a token file")
        self.size, texts = struct.unpack_from(">QQ", view, 4)
        self.ends = np.frombuffer(view, "<u8", texts, 20).astype(np.int64)
        at = 20 + 8 * texts
        (levels,), at, self.levels = struct.unpack_from("<I", view, at), at + 4, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", view, at)
            blocks = -(-n // STEP)
            chunks = np.frombuffer(view, np.uint8, n, at + 8)
            bitmap = np.frombuffer(view, np.uint8, blocks * (STEP // 8), at + 8 + n)
            ranks = np.frombuffer(view, "<u8", blocks, at + 8 + n + len(bitmap))
            self.levels.append((chunks, bitmap, ranks))
            at += 8 + n + len(bitmap) + 8 * blocks
        if len(self.levels[0][0]) != self.size or (self.ends[-1] if texts else 0) != self.size:
            raise ValueError("a damaged token file")

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i: those before its block, from the directory, and those of the block before it."""
        block = i // STEP
        inside = np.unpackbits(bitmap[block * (STEP // 8) : i // 8 + 1], bitorder="little")[: i - block * STEP]
        return int(ranks[block]) + int(inside.sum())

    def token(self, i: int) -> int:
        out, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return out
            i, shift = self._rank(bitmap, ranks, i), shift + 8
        return out

    def slice(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b: the same on a whole range; on each level the numbers that go on lie side by side from one rank on."""
        out = np.zeros(max(0, b - a), "<u4")
        if a >= b:
            return out
        at, shift = np.arange(b - a), 0
        for chunks, bitmap, ranks in self.levels:
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            on = np.unpackbits(bitmap[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            k = int(on.sum())
            if not k:
                break
            a = self._rank(bitmap, ranks, a)
            at, b, shift = at[on], a + k, shift + 8
        return out


def write_token_files(docs: DataFrame, vocabulary: str = tokens.WORD_BPE, end_id: int | None = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the tokens of all rows of docs (doc_id, text), in ascending doc_id order, as token files; returns the table that holds them.

    The files are the binary column ``file`` of a Parquet table in the shared folder (part, number, doc_ids, file), in the
    order of part and number. Null doc_ids come first; rows that repeat a doc_id follow each other, in the order of the input's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.tokenizer(vocabulary), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        names, held, size, number = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            lengths = [len(x) // encoder.dtype.itemsize for x in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([names], pa.list_(kind)), pa.array([encode(np.frombuffer(b"".join(held), encoder.dtype), lengths)], pa.binary())],
                ["part", "number", "doc_ids", "file"],
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                for name, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    names.append(name)
                    held.append(ids + end)
                    size += len(held[-1])
                    if size >= file_tokens * encoder.dtype.itemsize:
                        yield flush()
                        names, held, size, number = [], [], 0, number + 1
        if held:
            yield flush()

    ordered = (
        docs.select("doc_id", text_or_empty().alias("text"), F.monotonically_increasing_id().alias("_row"))
        .repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")
    )
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(ordered.mapInArrow(run, f"part bigint, number bigint, doc_ids array<{id_kind}>, file binary"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all rows before), n_tokens, ids_crc32 for each row, read back from the files.

    Lengths are those that the files hold, and starts follow from the sizes in their heads.
    """
    size = F.conv(F.hex(F.substring("file", 5, 8)), 16, 10).cast("bigint")
    sizes = materialize(files.select("part", "number", size.alias("size")), "token-sizes")
    base = materialize(running_base(sizes.groupBy("part").agg(F.sum("size").alias("total")), "part", "total", "base").select("part", "base"), "token-bases")
    inside = materialize(running_base(sizes, "number", "size", "inside", ["part"]).join(base, "part").select("part", "number", (F.col("base") + F.col("inside")).alias("start")), "token-starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            for doc_ids, data, start in zip(*(batch.column(k) for k in range(3)), strict=True):
                reader = Reader(data.as_buffer())
                ends = reader.ends
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(reader.slice(a, b)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(starts + start.as_py()), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    return files.join(inside, ["part", "number"]).select("doc_ids", "file", "start").mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents written as token files and read back."""
    return read_token_files(write_token_files(documents(spark, sf_dir)))
