import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import minhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, percent=85):
    """doc_id -> (size, component), every pair compared."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(a), find(i)) for i, a in sets}


def compare(df, rows):
    got = minhash.near_duplicates(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r.doc_id
    return want


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


def test_against_all_pairs(docs_of):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([7, 12, 40, 150, 600]))] + (passage if g % 2 else [])
        for k in range(rng.randrange(1, 9)):
            rows.append((rng.randrange(10**6), " ".join(edited(rng, base, max(0, k * len(base) // 150)))))
    chain = [rng.choice(vocabulary) for _ in range(300)]
    for _ in range(14):  # neighbours of a chain are linked, its ends are not
        rows.append((rng.randrange(10**6), " ".join(chain)))
        chain = edited(rng, chain, 3)
    hot = [rng.choice(vocabulary) for _ in range(80)]
    rows += [(2_000_000 + i, " ".join(hot[:-1] + [f"end{i}"])) for i in range(120)] + [(3_000_000 + i, " ".join(passage)) for i in range(30)]
    rows += [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (10, "one two"), (11, "İ one two three four"), (12, "x " * 50_000), (13, "x " * 50_001)]
    rows = list({i: (i, t) for i, t in rows}.values())
    want = compare(docs_of(rows, extra=True).repartition(5), rows)
    assert len({c for _, c in want.values()}) > 30


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=400, unique=True))
def test_signature_is_made_of_the_set(values):
    s = np.unique(np.array(values, np.uint64))
    sign = minhash.signature(s)
    assert set(sign.tolist()) <= set(s.tolist())
    for v in s[:5]:  # a bin that holds values keeps the least
        b = int(v) >> (64 - minhash.BIN_BITS)
        assert sign[b] == min(x for x in s.tolist() if x >> (64 - minhash.BIN_BITS) == b)


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 1200, dtype=np.uint64) * np.uint64(2)
    a, b = np.unique(pool[:1000]), np.unique(pool[200:])
    sign = lambda x, i: minhash.signature(np.unique(minhash._mixed(x + np.uint64(i))))
    agree = [(sign(a, i) == sign(b, i)).mean() for i in range(8)]
    assert abs(np.mean(agree) - 800 / 1200) < 0.05


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    edges = [(i, i - 1) for i in range(1, 40)] + [(100 + i, 100) for i in range(1, 200)] + [(500 + i, 500 + rng.randrange(i)) for i in range(1, 100) for _ in range(2)]
    edges += [(99, 50), (99, 60), (98, 60), (98, 70), (70, 51)]
    got = {r.v: r.p for r in minhash.components(spark.createDataFrame(edges, "v bigint, p bigint")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_nulls_ties_and_nothing(docs_of):
    assert minhash.near_duplicates(docs_of([])).collect() == []
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (None, "other words"), (3, text), (3, "something else entirely"), (4, "something else entirely"), (3, text), (9, text)]
    got = sorted(map(tuple, minhash.near_duplicates(docs_of(rows)).collect()), key=str)
    assert got == sorted([(None, 46, None, True), (None, 1, None, True), (3, 46, 3, True), (3, 1, 3, True), (4, 1, 3, False), (3, 46, 3, True), (9, 46, 3, False)], key=str)
    df = docs_of(rows, extra=True)
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "3", "None", "None"]


def test_tiles_and_shuffled_hubs_lose_no_link(docs_of, monkeypatch):
    """Leaves of one bucket that only their own pairs link, over several tiles, and with sides too large to broadcast."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(2, 7)))) for i in range(60)]
    monkeypatch.setattr(minhash, "TILE", 3)
    compare(docs_of(rows), rows)
    monkeypatch.setattr(minhash, "small", lambda df, _: df)
    monkeypatch.setattr(minhash, "fits_broadcast", lambda *_: False)
    compare(docs_of(rows), rows)


def test_drop_on_an_empty_table(docs_of):
    df = docs_of([], extra=True)
    assert minhash.drop_near_duplicates(df).collect() == [] and minhash.drop_near_duplicates(df).columns == df.columns


def test_ids_of_any_type(spark, docs_of):
    """Text ids give the groups that integers give."""
    rng = random.Random(8)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(5)]
    rows = [(10 + i, " ".join(edited(rng, base[i % 5], i % 2))) for i in range(40)] + [(60, ""), (61, None)]
    named = spark.createDataFrame([(f"id-{i}", t) for i, t in rows] + [(None, rows[0][1])], "doc_id string, text string")
    want = {f"id-{r.doc_id}": (r.n_shingles, f"id-{r.component_id}", r.kept) for r in minhash.near_duplicates(docs_of(rows)).collect()}
    got = minhash.near_duplicates(named).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id} == want and sum(not k for _, _, k in want.values()) > 10
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    stays = {r.doc_id for r in minhash.drop_near_duplicates(named).collect()}
    assert stays == {i for i, (_, _, k) in want.items() if k} | {None}
