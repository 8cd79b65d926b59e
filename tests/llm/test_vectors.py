"""Hard negatives and vector codes against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from lexloom.llm import hard_negatives as hn
from lexloom.llm import vector_codes as vc


@pytest.fixture
def table(spark):
    def make(rows, extra=False, kind="double", id_kind="bigint"):
        df = spark.createDataFrame(rows, f"vec_id {id_kind}, embedding array<{kind}>, label int")
        if extra:
            from pyspark.sql import functions as F

            for name in ("rid", "v", "code", "old", "upper", "lower", "leaf", "block", "slot", "low", "high", "floor", "team", "score", "id", "error", "_label"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows):
    kept = [(i, v, (c + 1) % 10 if i is not None and i % 7 == 0 else c) for i, v, c in rows if c is not None and fine(v)]
    dim = max((len(v) for _, v, _ in kept), default=0)
    ints = [[math.floor(256 * x) for x in v] + [0] * (dim - len(v)) for _, v, _ in kept]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, _, c) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(ints[a], ints[b], strict=True)), last(j), j, d) for b, (j, _, d) in enumerate(kept) if b != a)
        for s, _, j, _ in [r for r in scored if r[3] == c][:5]:
            hits = [r for r in scored if r[3] != c and 30 * -s <= 100 * -r[0] <= 90 * -s][:10]
            out += [(i, j, n, r[2], -s, -r[0]) for n, r in enumerate(hits, 1)]
    return sorted(out, key=repr)


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, c) for i, v, c in rows if fine(v)]
    dim = max((len(v) for _, v, _ in kept), default=0)
    width = max(1, -(-dim // parts))
    ints = [[math.floor(1024 * x) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, ints[r]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(ints[r], p) for r in order] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in ints:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for j, some in groups.items():
                books[p][j] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [[near(cut(v, p), books[p]) for p in range(parts)] for v in ints]
    errors = [sum(d for d, _ in c) for c in coded]
    by = {}
    for (_, _, c), e in zip(kept, errors, strict=True):
        by[c] = by.get(c, 0) + e
    return sorted(((i, "".join(f"{j:02x}" for _, j in c), e, by[k], sha) for (i, _, k), c, e in zip(kept, coded, errors, strict=True)), key=repr)


def negatives(df):
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hn.hard_negatives(df).collect()), key=repr)


def codes(df, **kw):
    return sorted((tuple(r) for r in vc.vector_codes(df, **kw).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def messy(rng, n, dim, grid=None):
    """Rows with ties, repeats, nulls and odd components."""
    value = lambda: rng.choice(grid) if grid else rng.gauss(0, 0.3)
    rows = []
    for i in range(n):
        v = [value() for _ in range(dim)] if rng.random() < 0.8 or not rows else list(rng.choice(rows)[1] or [0.0] * dim)
        rows.append((i * rng.choice([1, 1, 1, 25]), v, rng.choice([0, 1, 2, None])))
    bad = [None, [None] * dim, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [0.0] * (dim - 1) + [float("-inf")]]
    rows += [(100, v, 1) for v in bad] + [(None, rows[0][1], 0), (None, rows[1][1], None), rows[2], rows[2], (700, rows[3][1], None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,grid", [(1, None), (2, [-0.5, 0.0, 0.25, 0.5])])
def test_negatives_against_brute_force(table, monkeypatch, seed, grid):
    for name, size in (("LEAF_ROWS", 60), ("BLOCK_ROWS", 25), ("BUCKET", 4), ("GROUP", 2), ("AT_ONCE", 3)):
        monkeypatch.setattr(hn, name, size)
    rows = messy(random.Random(seed), 300, 6, grid)
    want = brute_negatives(rows)
    assert len(want) > 20
    assert negatives(table(rows, extra=True)) == want


def test_negatives_where_a_third_of_rows_is_one_vector(table, monkeypatch):
    for name, size in (("LEAF_ROWS", 50), ("BLOCK_ROWS", 20), ("BUCKET", 4)):
        monkeypatch.setattr(hn, name, size)
    rng = random.Random(5)
    one = [0.5, 0.25, -0.5, 0.125]
    rows = [(i, one if i % 3 == 0 else [rng.gauss(0, 0.5) for _ in range(4)], i % 4) for i in range(240)]
    assert negatives(table(rows)) == brute_negatives(rows)


def test_negatives_of_small_tables(table):
    assert negatives(table([])) == []
    assert negatives(table([(0, [0.5], 1)])) == []
    assert negatives(table([(0, None, 1), (1, [0.5], None)])) == []
    assert hn.hard_negatives(table([])).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [(0, [1.0, 0.5], 3), (1, [1.0], 4), (2, [1.0, 0.25, 0.5], 4), (3, [0.5, 0.5], 3), (4, [], 3)]
    assert negatives(table(rows)) == brute_negatives(rows)
    with pytest.raises(ValueError):
        negatives(table([(0, [1e30], 1), (1, [1.0], 1)]))


def test_tree_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (500, 8))
    radius2 = float((x * x).sum(axis=1).max())
    tree = hn.Tree(x, radius2, 16)
    leaf = tree.route(x)
    assert all((leaf[m] == i).all() for i, m in enumerate(tree.members))
    low, high = hn.padded(tree, {i: tree.spans(x[m], i) for i, m in enumerate(tree.members)})
    q = rng.integers(-300, 300, (40, 8))
    upper, lower = tree.bounds(q, low, high)
    score = q @ x.T
    assert (score <= upper[:, leaf]).all() and (score >= lower[:, leaf]).all()


@pytest.mark.parametrize("seed,grid,entries", [(1, None, 256), (2, [-0.5, 0.0, 0.25, 0.5], 256), (3, None, 12), (4, [0.0, 0.001, 0.002], 5)])
def test_codes_against_brute_force(table, seed, grid, entries):
    rows = messy(random.Random(seed), 400, 8, grid)
    assert codes(table(rows, extra=True), entries=entries) == brute_codes(rows, entries=entries)


def test_codes_of_small_tables(table):
    assert codes(table([])) == [] and codes(table([(1, None, 0)])) == []
    for rows in ([(5, [0.5, -0.25], 1)], [(1, [], None)], [(3, [0.1] * 4, None), (3, [0.1] * 4, None), (2, [0.3] * 5, 1)]):
        assert codes(table(rows)) == brute_codes(rows)
    with pytest.raises(ValueError):
        codes(table([(0, [1e30], 1)]))


def test_ids_of_any_type(table):
    rows = [(f"v{i}", [float(i), 1.0], 0) for i in range(5)]
    got = codes(table(rows, id_kind="string"))
    assert [r[0] for r in got] == [r[0] for r in rows] and len({r[1] for r in got}) == 5 and {r[2] for r in got} == {0}


def test_bounds_skip_rows_and_change_nothing():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 12, (300, 5)) for c in (-800, 0, 900)]).astype(np.int64)
    book = x[::90].copy()
    code, first, second = vc.scan(x, book)
    upper, lower, skipped = vc._up(first), vc._down(second), 0
    for _ in range(6):
        new = book.copy()
        for j in np.unique(code):
            new[j] = x[code == j].sum(axis=0) // (code == j).sum()
        code, upper, lower, scanned = vc.reassigned(x, new, code, upper, lower, vc.Moves(book, new))
        book = new
        want, _, _ = vc.scan(x, book)
        assert (code == want).all()
        skipped += len(x) - scanned
    assert skipped > len(x)
