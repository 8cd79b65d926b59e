"""A counting quotient filter over 64-bit fingerprints, held in sorted-run form.

A fingerprint splits into a quotient (its high bits, the home slot) and a remainder. The remainders of one quotient form a run, sorted;
runs follow each other in quotient order. ``occupied`` has a bit for each quotient with a run, ``runend`` a bit for each slot that ends
one, and ``counted`` a bit for each slot whose fingerprint occurs more than once, with its count in ``counts``. As all 64 bits are
kept between quotient and remainder, a filter is exact on fingerprints, and merging filters loses nothing.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BBQQ")


def encode(fingerprints: np.ndarray, counts: np.ndarray, block_bits: int = 0, q_bits: int | None = None) -> bytes:
    """fingerprints: ascending, distinct uint64 that share their top block_bits; counts: int64, at least 1."""
    n = len(fingerprints)
    if q_bits is None:
        q_bits = max(3, min(24, int(n).bit_length()))
    q_bits = min(q_bits, 64 - block_bits)
    r_bits = 64 - block_bits - q_bits
    body = fingerprints << np.uint64(block_bits) if block_bits else fingerprints
    quotient = (body >> np.uint64(64 - q_bits)).astype(np.int64)
    remainder = fingerprints & np.uint64((1 << r_bits) - 1)
    occupied = np.zeros(1 << q_bits, bool)
    occupied[quotient] = True
    runend = np.ones(n, bool)
    runend[:-1] = quotient[1:] != quotient[:-1]
    counted = counts > 1
    r_bytes = (r_bits + 7) // 8
    packed = remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :r_bytes]
    return b"".join((
        _HEAD.pack(q_bits, r_bits, n, int(counted.sum())), np.packbits(occupied).tobytes(), np.packbits(runend).tobytes(),
        np.packbits(counted).tobytes(), packed.tobytes(), counts[counted].astype("<i8").tobytes(),
    ))


def decode(data: bytes, block: int = 0, block_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The distinct fingerprints, ascending, and their counts."""
    q_bits, r_bits, n, k = _HEAD.unpack_from(data)
    at = _HEAD.size

    def bits(size: int) -> np.ndarray:
        nonlocal at
        length = (size + 7) // 8
        out = np.unpackbits(np.frombuffer(data, np.uint8, length, at), count=size).astype(bool)
        at += length
        return out

    occupied, runend, counted = bits(1 << q_bits), bits(n), bits(n)
    r_bytes = (r_bits + 7) // 8
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :r_bytes] = np.frombuffer(data, np.uint8, n * r_bytes, at).reshape(n, r_bytes)
    at += n * r_bytes
    counts = np.ones(n, np.int64)
    counts[counted] = np.frombuffer(data, "<i8", k, at)
    run = np.cumsum(runend) - runend
    quotient = np.flatnonzero(occupied).astype(np.uint64)[run] if n else np.zeros(0, np.uint64)
    out = wide.view("<u8").reshape(n) | (quotient << np.uint64(r_bits) if r_bits < 64 else np.uint64(0))
    if block_bits:
        out = out | (np.uint64(block) << np.uint64(64 - block_bits))
    return out, counts


def summed(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct fingerprints with their counts added up."""
    if not len(fingerprints):
        return fingerprints, counts
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], fingerprints[1:] != fingerprints[:-1])))
    return fingerprints[first], np.add.reduceat(counts, first)


def blocks(fingerprints: np.ndarray, block_bits: int) -> list[tuple[int, bytes]]:
    """A filter for each block (the value of the top block_bits) that has fingerprints. Input in any order, with repeats."""
    found, counts = summed(fingerprints, np.ones(len(fingerprints), np.int64))
    top = (found >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(found), np.int64)
    starts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))) if len(found) else []
    ends = [*starts[1:], len(found)] if len(found) else []
    return [(int(top[a]), encode(found[a:b], counts[a:b], block_bits)) for a, b in zip(starts, ends, strict=True)]


def merge(filters: list[bytes], block: int = 0, block_bits: int = 0) -> bytes:
    """One filter for all: runs are merged by sorted remainders, counts of equal ones add up."""
    parts = [decode(x, block, block_bits) for x in filters]
    if not parts:
        return encode(np.zeros(0, np.uint64), np.zeros(0, np.int64), block_bits)
    return encode(*summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])), block_bits)
