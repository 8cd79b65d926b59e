"""Passages that repeat across documents against brute force over every string."""

import hashlib
import random

import numpy as np
import pytest

from lexloom.llm import suffix_dedup as sd


def brute(rows, span=50):
    """(doc_id, n_bytes, spans, sha of what is kept) of each row; a null doc_id comes after all others."""
    last = lambda i: (i is None, i if i is not None else 0)
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for k in range(len(b) - span + 1):
            w = b[k : k + span]
            if w not in first or last(i) < first[w]:
                first[w] = last(i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if first[b[k : k + span]] < last(i):
                gone[k : k + span] = b"\1" * span
        runs, k = [], 0
        while k < len(b):
            if gone[k]:
                start = k
                while k < len(b) and gone[k]:
                    k += 1
                runs.append((start, k))
            else:
                k += 1
        out.append((i, len(b), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(df, span=50):
    rows = sd.without_repeats(df, span).collect()
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], hashlib.sha256(r.kept).hexdigest()) for r in rows), key=repr)


def corpus(seed, n, alphabet="abcdefgh ăé"):
    """Texts with shared passages of all lengths around a window, copies, near copies, periodic runs."""
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [text(k) for k in (30, 45, 49, 50, 51, 60, 90, 300)] + ["ab" * 60, "a" * 130]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            t = rng.choice(rows)[1] or ""
        elif kind < 0.4 and rows and (t := rng.choice(rows)[1]):
            at = rng.randrange(len(t))
            t = t[:at] + "#" + t[at + 1 :]
        else:
            t = "".join(rng.choice([text(rng.randrange(80)), rng.choice(passages)]) for _ in range(rng.randrange(6)))
        rows.append((rng.randrange(10 * n), t))
    rows += [(None, rows[0][1]), (None, passages[-1] + "x"), (5, None), (6, ""), rows[1], rows[1], (rows[2][0], passages[7])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,alphabet", [(1, "abcdefgh ăé"), (2, "ab")])
def test_against_every_string(docs_of, monkeypatch, seed, alphabet):
    for name, size in (("CHUNK_BYTES", 1500), ("PIECE_BYTES", 400), ("BUCKET_ENTRIES", 50), ("HOT_CHUNKS", 2)):
        monkeypatch.setattr(sd, name, size)
    rows = corpus(seed, 70, alphabet)
    want = brute(rows)
    assert sum(bool(r[2]) for r in want) > 20
    assert found(docs_of(rows, extra=True)) == want


def test_defaults_with_a_hot_passage(docs_of):
    """A passage in every document, each time before and behind other text."""
    rng = random.Random(9)
    hot = "This line is licensed to whoever reads it, with no warranty whatsoever. " * 2
    rows = [(i, "".join(rng.choice("abcdef") for _ in range(60)) + hot + "".join(rng.choice("uvwxyz") for _ in range(60))) for i in range(150)]
    want = brute(rows)
    assert found(docs_of(rows).repartition(8)) == want
    assert all(len(r[2]) == 1 for r in want if r[0])


@pytest.mark.parametrize("span", [8, 33, 120])
def test_other_spans(docs_of, span):
    rows = corpus(3, 30)
    assert found(docs_of(rows), span) == brute(rows, span)


def test_small_tables(docs_of):
    assert found(docs_of([])) == []
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 49), (5, "x" * 49), (6, "y" * 50), (7, "y" * 50), (7, "y" * 50)]
    assert found(docs_of(rows)) == brute(rows)
    assert found(docs_of([(1, None)])) == brute([(1, None)])


def test_very_long_text(docs_of, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK_BYTES", 1 << 12)
    monkeypatch.setattr(sd, "PIECE_BYTES", 1 << 13)
    rng = np.random.default_rng(2)
    long = "".join(map(chr, rng.integers(97, 123, 60_000)))
    rows = [(1, long[20_000:20_080]), (2, long), (3, long[:30_000])]
    assert found(docs_of(rows)) == brute(rows)


def test_ids_of_any_type(spark):
    rows = [(f"d{i:02}", f"{'shared passage of text ' * 4}{i}") for i in range(12)] + [(None, "shared passage of text " * 4)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    want = {(r[0], tuple(r[2])) for r in brute([(i if d is not None else None, t) for i, (d, t) in enumerate(rows)])}
    assert {(r[0], tuple(r[2])) for r in found(df)} == {(None if i is None else f"d{i:02}", s) for i, s in want}


def test_windows_lie_in_one_phrase_each():
    rng = np.random.default_rng(3)
    body = rng.integers(97, 100, 3000).astype(np.uint8)
    ends = np.array([0, 40, 49, 1000, 1000, 1050, 3000])
    a, b, h, x = sd.phrases(body, ends)
    windows = [s for i, j in zip(a, b, strict=True) for s in range(i, j + 1)]
    starts = np.concatenate(([0], ends[:-1]))
    assert windows == [s for i, j in zip(starts, ends, strict=True) for s in range(i, j - 49)]
    # Equal windows have equal triggers.
    of = {s: h[k] for k, (i, j) in enumerate(zip(a, b, strict=True)) for s in range(i, j + 1)}
    seen = {}
    for s in windows:
        assert seen.setdefault(body[s : s + 50].tobytes(), of[s]) == of[s]
    assert (b - a).max() < sd.lengths(50)[1]


def test_pieces_of_a_long_text_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(sd, "PIECE_BYTES", 100)
    rng = np.random.default_rng(6)
    body = rng.integers(97, 100, 2000).astype(np.uint8)
    for ends in ([2000], [30, 1500, 2000], [249, 299, 2000], [10, 11, 211, 411, 2000]):
        ends = np.array(ends)
        a, b, h, _ = sd.phrases(body, ends)
        starts = np.concatenate(([0], ends[:-1]))
        assert [s for i, j in zip(a, b, strict=True) for s in range(i, j + 1)] == [s for i, j in zip(starts, ends, strict=True) for s in range(i, j - 49)]


def test_suffix_order():
    rng = np.random.default_rng(4)
    body = rng.integers(97, 99, 500).astype(np.uint8)
    at = np.arange(440)
    order, new = sd.suffix_order(body, at, 60)
    shown = [body[i : i + 60].tobytes() for i in at[order]]
    assert shown == sorted(shown) and list(new) == [True] + [p != q for p, q in zip(shown, shown[1:], strict=False)]
