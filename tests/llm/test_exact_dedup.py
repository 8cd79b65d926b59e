import hashlib

import numpy as np

from lexloom.llm import exact_dedup
from lexloom.llm import quotient_filter as qf

ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "x" * 300_000), (7, "x" * 300_000), (None, "a"), (None, "lone"), (8, "tie"), (8, "tie"), (9, "A"), (10, "a ")]


def test_quotient_filter_round_trip_and_lossless_merge():
    rng = np.random.default_rng(1)
    for bits in (0, 3, 6):
        values = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
        values = np.concatenate([values, values[:700], values[:50], np.array([0, 0, (1 << 64) - 1], np.uint64)])
        want = dict(zip(*np.unique(values, return_counts=True), strict=True))
        got = {}
        halves = [qf.blocks(values[:3000], bits), qf.blocks(values[3000:], bits)]
        for block in sorted({b for h in halves for b, _ in h}):
            merged = qf.merge([f for h in halves for b, f in h if b == block], block, bits)
            got |= dict(zip(*qf.decode(merged, block, bits), strict=True))
        assert got == want
    assert qf.blocks(np.zeros(0, np.uint64), 4) == []


def test_groups(docs_of):
    got = exact_dedup.exact_duplicates(docs_of(ROWS, extra=True)).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    for text in {t or "" for _, t in ROWS}:
        group, ids = by[hashlib.sha256(text.encode()).hexdigest()], [i for i, t in ROWS if (t or "") == text]
        assert len(group) == len(ids) and {r.group_size for r in group} == {len(ids)}
        assert {r.keep_id for r in group} == {max((i for i in ids if i is not None), default=None)}
        assert sum(r.kept for r in group) == 1 and all(r.doc_id == r.keep_id for r in group if r.kept)


def test_slow_path_agrees(docs_of):
    df = docs_of(ROWS)
    key = lambda rows: sorted(map(str, rows))
    assert key(exact_dedup._by_bytes(df).collect()) == key(exact_dedup.exact_duplicates(df).collect())


def test_dropping(docs_of):
    df = docs_of(ROWS, extra=True)
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert sorted((r.text or "") for r in rows) == sorted({t or "" for _, t in ROWS})
    assert {r.doc_id for r in rows if r.text == "a"} == {2} and {r.doc_id for r in rows if not r.text} == {5}


def test_empty(docs_of):
    assert exact_dedup.exact_duplicates(docs_of([])).collect() == []
    assert exact_dedup.drop_exact_duplicates(docs_of([])).collect() == []
