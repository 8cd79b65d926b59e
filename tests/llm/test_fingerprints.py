import base64
import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from lexloom.llm import fingerprints as fp


def parts(text):
    cut = re.split(r"\n+", text) + [x[i : i + 256] for x in re.split(r"[\n.!?|]+", text) for i in range(0, len(x), 256)]
    return {p.strip(" ") for p in cut} - {""}


def cells_of(fingerprint):
    n, *cells = struct.unpack(f">{len(base64.b64decode(fingerprint)) // 8}q", base64.b64decode(fingerprint))
    return n, [cells[i : i + 12] for i in range(0, len(cells), 12)]


def peel(a, b):
    """Of two fingerprints, in plain Python: numbers of digests, and the digests that differ or None if some are stuck."""
    (n, x), (m, y) = cells_of(a), cells_of(b)
    size = min(len(x), len(y))
    diff = [[0] * 12 for _ in range(size)]
    for shards in (x, y):
        for i, shard in enumerate(shards):
            diff[i * size // len(shards)] = [p ^ q for p, q in zip(diff[i * size // len(shards)], shard)]
    xxh = lambda v: xxhash.xxh64_intdigest(struct.pack("<q", v), 42)
    whole = lambda c: c and xxh(c >> 20 & (1 << 44) - 1) & (1 << 20) - 1 == c & (1 << 20) - 1
    out = set()
    for shard in diff:
        for _ in range(fp.ROUNDS):
            for c in {c for c in shard if whole(c)}:
                out.add(c)
                for i in range(12):
                    shard[i] ^= c if c >> 20 + i & 1 else 0
    return n, m, None if any(map(any, diff)) else out


def alike(a, b):
    a, b = parts(a), parts(b)
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = ["", None, "One. Two! Three? Four\nfive | six", "one", "😀😀😀. ñ. é", "same. text. here", "same. text. here", " ".join(f"part {i}." for i in range(700)), "\n".join(f"line {i}" for i in range(400)), "x" * 200_000, "a. " * 60_000, "\n\n.. !", "tail. end"]


def test_edits_and_likeness(docs_of):
    rows = [(i * 37 % 101, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in fp.fingerprints(docs_of(rows, extra=True).repartition(3)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited, r = text[: len(text) - half] + following[:half], got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(alike(text, edited)) and r.near_next == pytest.approx(alike(text, following))
    same = [got[i].fingerprint for i, t in rows if t == "same. text. here"]
    assert same[0] == same[1] and len({r.fingerprint for r in got.values()}) == len({frozenset(parts(t or "")) for _, t in rows})


def test_next_over_many_buckets(docs_of, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 3)
    ids = [1, 2, 3, 5, 8, 1000, 1001, 10**15, -7, -(10**12), 6, 7, 9, 10, 11, None]
    got = {r.doc_id: (r.text, r.following) for r in fp.with_next(docs_of([(i, f"t{i}") for i in ids])).collect()}
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    assert got == {i: (f"t{i}", f"t{order[(k + 1) % len(order)]}") for k, i in enumerate(order)}
    ties = fp.with_next(docs_of([(1, "b"), (1, "a"), (1, "a"), (0, "c")])).collect()
    assert sorted((r.text, r.following) for r in ties) == [("a", "a"), ("a", "b"), ("b", "c"), ("c", "a")]


def test_one_and_none(docs_of):
    assert fp.fingerprints(docs_of([])).collect() == []
    (r,) = fp.fingerprints(docs_of([(4, "ab. cd")])).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"ab.ab.").hexdigest()


def sketched(df, *names):
    df = df.select(*[fp.digests(F.col(c)).alias(c) for c in names])
    return fp.with_sketches(df, *names)


def test_peeling_recovers_what_differs(spark):
    a, b = "\n".join(f"paragraph {i}" for i in range(200)), "\n".join(f"paragraph {i}" for i in range(3, 204))
    df = sketched(spark.createDataFrame([(a, b), (a, a), (a, "one"), (a, ""), ("", "")], "a string, b string"), "a", "b")
    rows = fp.with_difference(df, "a", "b", "out").collect()
    assert [len(r.out) for r in rows] == [7, 0, 201, 200, 0] and all(set(r.out) == set(r.a) ^ set(r.b) for r in rows)


def test_one_shard_subtracts_peels_and_gets_stuck(spark):
    df = spark.createDataFrame([("\n".join(f"long paragraph number {i:040}" for i in range(40)),)], "t string").select(fp.digests(F.col("t")).alias("d"))
    shard = lambda x, y: fp._compared(F.array(F.struct(x.alias("a"), y.alias("b"))))[0]["d"]
    few, many = df.select(shard(F.col("d"), F.slice("d", 3, 100)).alias("few"), shard(F.col("d"), F.slice("d", 40, 0)).alias("many")).first()
    assert not few.stuck and len(few.out) == 2 and many.stuck


def test_stored_fingerprints_are_subtracted_and_peeled(spark, docs_of):
    text = lambda a, b: ". ".join(f"sentence {i} of a version" for i in range(a, b))
    pairs = [(text(0, 300), text(2, 300)), (text(0, 300), text(0, 300)), (text(0, 7), text(0, 9)), (text(0, 300), text(0, 8)), ("", ""), ("", "one"), (text(0, 80), text(80, 160))]
    df = sketched(spark.createDataFrame(pairs, "a string, b string"), "a", "b")
    stored = df.select("a", "b", *[fp.encoded(F.size(c), F.col(f"{c}_cells")).alias(f"fp_{c}") for c in "ab"], F.lit(1).alias("_seen"))
    seen = []
    for r in fp.compared(stored, "fp_a", "fp_b").collect():
        n, m, out = peel(r.fp_a, r.fp_b)
        assert (n, m) == (len(r.a), len(r.b)) and r.stuck == (out is None) and r._seen == 1
        assert r.stuck or set(r.differing) == out == set(r.a) ^ set(r.b)
        assert r.near == (None if r.stuck else pytest.approx(len(set(r.a) & set(r.b)) / len(set(r.a) | set(r.b)) if r.a or r.b else 1.0))
        seen.append(r.stuck)
    assert seen[:3] == [False] * 3 and seen[3] and not any(seen[4:6])


def test_likeness_of_the_query_is_that_of_its_fingerprints(spark):
    got = fp.compared(fp.op3_fingerprints(spark, "/root/testdata/sf0.001"), "fingerprint", "edited_fingerprint").collect()
    peeled = [r for r in got if not r.stuck]
    assert len(peeled) > 10 and all(r.near == r.near_edited for r in peeled)
    for r in got:
        n, m, out = peel(r.fingerprint, r.edited_fingerprint)
        assert r.stuck == (out is None) and (r.stuck or r.near_edited == pytest.approx((n + m - len(out)) / (n + m + len(out)) if n + m else 1.0))


def test_folding_a_sketch_gives_the_smaller_sketch(spark):
    df = spark.createDataFrame([("\n".join(f"line {i}" for i in range(300)),)], "t string").select(fp.digests(F.col("t")).alias("d"))
    for bits in (0, 1, 3):
        r = df.select(fp.sketch(F.col("d"), F.lit(bits)).alias("small"), fp.folded(fp.sketch(F.col("d"), F.lit(5)), F.lit(1 << bits)).alias("folded")).first()
        assert r.small == r.folded


def test_encoded_cells(spark):
    df = spark.createDataFrame([("one\n" + "two" * 60,)], "t string").select(fp.digests(F.col("t")).alias("d"))
    r = df.select("d", fp.encoded(F.size("d"), fp.sketch(F.col("d"), F.lit(0))).alias("e")).first()
    n, (cells,) = cells_of(r.e)
    one, two = r.d
    assert n == 2 and all(cells.count(x) <= 3 for x in (one, two)) and set(cells) <= {0, one, two, one ^ two} and {0} != set(cells)
    back = df.select(fp.decoded(fp.encoded(F.size("d"), fp.sketch(F.col("d"), F.lit(2)))).alias("x"), fp.sketch(F.col("d"), F.lit(2)).alias("y")).first()
    assert back.x.n == 2 and back.x.cells == back.y


def test_one_rule_at_every_length(spark):
    """Also for texts of a few hundred to many thousand code points in one line, and around any size at which a rule might change."""
    sentences = [f"sentence number {i} of one line" for i in range(600)]
    rows = [(n, ". ".join(sentences[:n]), ". ".join(["changed", *sentences[1:n]])) for n in (10, 44, 45, 46, 47, 200, 600)]
    df = sketched(spark.createDataFrame([r[1:] for r in rows], "a string, b string"), "a", "b")
    got = fp.with_difference(df, "a", "b", "out").withColumn("near", fp.likeness(F.size("a"), F.size("b"), F.col("out"))).collect()
    for (n, *_), r in zip(rows, got, strict=True):
        assert len(r.a) == n + 1 and r.near == pytest.approx((n - 1) / (n + 3)), n  # the line and one sentence differ
    plain = "".join(f"word{i} " for i in range(4000))
    for n in (1499, 1500, 20_000):
        (r,) = sketched(spark.createDataFrame([(plain[:n], plain[: n // 2] + "!" + plain[:n][::-1])], "a string, b string"), "a", "b").collect()
        assert len(set(r.a) & set(r.b)) == n // 2 // 256  # no sentence marks: whole parts of 256 code points


@pytest.mark.parametrize("bits", [0, 1, 5, 9])
def test_shards_hold_digests_by_their_first_bits(spark, bits):
    df = spark.createDataFrame([("\n".join(f"line {i}" for i in range(300)),)], "t string").select(fp.digests(F.col("t")).alias("d"))
    r = df.select("d", fp._shards(F.col("d"), F.lit(bits)).alias("s")).first()
    firsts = range(-(1 << bits >> 1), (1 << bits) + 1 >> 1)
    assert r.s == [sorted(x for x in r.d if bits == 0 or x >> (64 - bits) == i) for i in firsts]


def test_ids_of_any_type(spark, docs_of):
    """Text ids in the order of integers give the fingerprints that integers give."""
    rows = [(i, f"One line {i % 3}. Another {i}.\nThird {i // 2}") for i in range(100, 130)] + [(100, "again"), (None, "null")]
    named = spark.createDataFrame([(None if i is None else f"d{i}", t) for i, t in rows], "doc_id string, text string")
    shown = lambda df: sorted((str(r.doc_id).lstrip("d"), *r[1:]) for r in df.collect())
    assert shown(fp.fingerprints(named)) == shown(fp.fingerprints(docs_of(rows)))
