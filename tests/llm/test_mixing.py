import re

import pytest

from lexloom.llm import mixing


def filled(sizes, weights, share, most):
    """Reshares the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped = dict.fromkeys(names, 0.0), set()
    budget = share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(most * sizes[s] for s in capped)
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = most * sizes[s]
        capped |= set(over)


def test_targets_and_takes(docs_of):
    rows = [(i, "w " * (i % 7 + 1) + " x\x0by", "en", s) for i, s in enumerate(["b"] * 300 + ["a"] * 20 + [None] * 80 + ["é"] * 50 + ["c"] * 5)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "void"), (None, "p q", "en", "b"), (3, "again", "en", "b")]
    got = mixing.mixture(docs_of(rows, extra=True)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = filled(sizes, (5, 2, 1), 1.5, 2)
    texts = {}
    for i, t, _, s in rows:
        texts.setdefault(i, []).append((size(t), s))
    taken = {}
    for r in got:
        s = next(s for n, s in texts[r.doc_id] if n == r["size"] and sizes[s] == r.source_size)
        assert r.target == pytest.approx(want[s], rel=1e-9)
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert r.copies in (int(rate + 1e-9), int(rate + 1e-9) + 1, int(rate)) and r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert taken["b"] == pytest.approx(want["b"], rel=0.15)
    again = mixing.mixture(docs_of(rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_repeats_rows(docs_of):
    rows = [(i, "one two three", "en", "s" if i % 3 else "t") for i in range(90)] + [(None, None, None, None)]
    df = docs_of(rows, extra=True)
    out = mixing.mix(df)
    assert out.columns == df.columns
    copies = {r.doc_id: r.copies for r in mixing.mixture(df).collect()}
    count = {}
    for r in out.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {k: v for k, v in copies.items() if v}


def test_empty(docs_of):
    assert mixing.mixture(docs_of([])).collect() == [] and mixing.mix(docs_of([])).collect() == []
    assert [r.taken for r in mixing.mixture(docs_of([(1, None, "en", None)])).collect()] == [0]


@pytest.mark.parametrize("block", [mixing.BLOCK, 7])
def test_equal_rows_draw_each_for_itself(docs_of, monkeypatch, block):
    """Also null doc_ids and rows equal in all columns: totals still come near the targets."""
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = [(None, f"one two t{i % 50}", "en", "a") for i in range(2000)] + [(5, "same text", "en", "b") for _ in range(2000)] + [(i, "x y z", "en", None) for i in range(10, 400)]
    df = docs_of(rows, extra=True)
    got = mixing.mixture(df.repartition(5)).collect()
    assert len(got) == len(rows)
    for size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == size]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.1)
    again = mixing.mixture(df.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert sorted(str(r.doc_id) for r in mixed.collect()) == sorted(x for r in got for x in [str(r.doc_id)] * r.copies)
