import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from lexloom import scratch  # noqa: E402
from lexloom.llm import common, mixing, quality  # noqa: E402
from tests.llm.test_minhash import brute  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = common.documents(spark, DATA)
    columns, before = docs.columns, None
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.materialize(stage(spark, docs, DATA), "test")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns and [t for _, t in docs.dtypes] == [t for _, t in before.dtypes]
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    given, kept = map(rows, seen["quality"])
    scores = {r.doc_id: r.score for r in quality.quality_scores(seen["quality"][0], common.labels(spark, DATA)).collect()}
    assert set(kept) == {i for i in given if scores[i] >= quality.THRESHOLD} and len(kept) < len(given)

    given, kept = map(rows, seen["exact dedup"])
    last = {}
    for i, t in given.items():
        last[t] = max(i, last.get(t, i))
    assert set(kept) == set(last.values()) and len(kept) < len(given)

    given, kept = map(rows, seen["near dedup"])
    groups = brute(list(given.items()), 80)
    assert set(kept) == {c for _, c in groups.values()} and len(kept) < len(given)

    given, out = seen["mixture"]
    copies = {r.doc_id: r.copies for r in mixing.mixture(given).collect()}
    assert Counter(r.doc_id for r in out.collect()) == {i: n for i, n in copies.items() if n}

    given, pieces = seen["packing"]
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in given.collect():
        want[r.doc_id] += len(encoder.encode(r.text, add_special_tokens=False).ids) + 1
    got = pieces.groupBy("doc_id").sum("length").collect()
    assert {r.doc_id: r["sum(length)"] for r in got} == want
    lengths = [r["sum(length)"] for r in pieces.groupBy("sequence_id").sum("length").collect()]
    assert sorted(lengths)[1:] == [2048] * (len(lengths) - 1) and np.sum(lengths) == sum(want.values())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def _stages(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.materialize(stage(spark, docs, DATA), "test")
        assert name == "packing" or docs.columns == before.columns
    return docs


def test_edges_of_all_stages(spark, docs_of):
    assert _stages(spark, docs_of([], extra=True)).count() == 0
    plain = [r.text for r in common.documents(spark, DATA).limit(40).collect()]
    rows = [(i, t, "en", "s") for i, t in enumerate(plain)] + [(100, None, None, None), (101, "", "en", None), (None, plain[0], None, "s"), (102, plain[1], None, None), (5, plain[5], "en", "s")]
    out = _stages(spark, docs_of(rows, extra=True)).collect()
    assert out and {r.doc_id for r in out} <= {i for i, *_ in rows}


def test_text_ids_lose_no_stage(spark, docs_of):
    """Near copies under text ids go, as they do under numbers."""
    plain = [r.text for r in common.documents(spark, DATA).orderBy("doc_id").limit(30).collect()]
    near = [" ".join([*t.split(" ")[:-1], "other"]) for t in plain if len(t.split()) > 60]
    docs = docs_of([(1000 + i, t, "en", "s") for i, t in enumerate([*plain, *near])])
    kept = lambda df: {str(r.doc_id) for r in corpus_pipeline.drop_near_copies(spark, df, DATA).collect()}
    want = kept(docs)
    assert kept(docs.withColumn("doc_id", docs["doc_id"].cast("string"))) == want and len(want) < len(plain) + len(near)


def test_run_leaves_only_the_last_tables(spark):
    before = set(common._written)
    corpus_pipeline.run(spark, DATA).count()
    left = {p.split("/lexloom/")[1].rsplit("-", 1)[0] for p in set(common._written) - before}
    assert left == {"stage-mixture", "pack-ids", "pack-base"}


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Session())


def test_arrow_batches_are_bounded(spark, docs_of):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "64m")
    common.materialize(docs_of([(1, "x")]), "test")
    assert spark.conf.get(key) == f"{common.BATCH_BYTES}b"
    spark.conf.set(key, "1024b")
    common.materialize(docs_of([(1, "x")]), "test")
    assert spark.conf.get(key) == "1024b"
    spark.conf.unset(key)
