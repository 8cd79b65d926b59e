"""Whole drivers: paged sources, streams with expiring state, counted writes, evaluation chains, exact order statistics."""

import datetime
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import corpus, lexicon, metrics, models, patterns, vector
from lexloom.plans import catalog, drivers
from lexloom.sources import counted, paged
from lexloom.streaming import state

FULL, NONE = json.dumps({"result": [{"id": "v"}]}), json.dumps({"result": []})
BOOK = {"a": [FULL, NONE, FULL, NONE, NONE, FULL], "b": [FULL], "c": [FULL] * 5, "d": [FULL, "broken", FULL], "e": []}


def fetch(query, page):
    if query == "f":
        raise OSError("down")
    return BOOK[query][page - 1] if page <= len(BOOK[query]) else None


def test_paged_source(spark):
    got = paged.fetched_pages(spark, fetch, ["a", "b", "c", "d", "e", "f", "a"], done=["c"], name="paged_test")
    assert got.rdd.getNumPartitions() == 5  # one for each query
    assert sorted((r.query, r.page) for r in got.collect()) == [("a", 1), ("a", 3), ("b", 1), ("d", 1)]
    assert paged.fetched_pages(spark, fetch, ["c"], most=3, name="paged_test").count() == 3
    assert paged.fetched_pages(spark, fetch, [], name="paged_test").count() == 0


def test_paged_stream_goes_on_behind_done_queries(spark, tmp_path):
    def run(queries):
        stream = paged.streamed_pages(spark, fetch, queries, name="paged_stream")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.query, r.page) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run(["a", "b"]) == [("a", 1), ("a", 3), ("b", 1)]
    assert run(["a", "b", "d"]) == [("a", 1), ("a", 3), ("b", 1), ("d", 1)]


def test_store_fetch(spark, tmp_path):
    rows = spark.createDataFrame([("x y", 1, FULL), ("x y", 2, NONE)], "query string, page int, value string")
    rows.write.partitionBy("query", "page").text(f"{tmp_path}/api")
    get = paged.store_fetch(f"file://{tmp_path}/api")
    assert [get("x y", k) for k in (1, 2, 3)] == [FULL, NONE, None]


def test_bucket_fetch(spark, tmp_path, monkeypatch):
    """Files and partitions don't grow in number with pages and queries; a page that is there twice is broken, and a query without pages ends."""
    rows = [(f"q {i}", k, NONE if k == 2 else FULL) for i in range(40) for k in (1, 2, 3)] + [("q 7", 3, FULL)]
    paged.land(spark.createDataFrame(rows, "query string, page int, value string"), f"file://{tmp_path}/api", 3)
    assert len(list((tmp_path / "api").rglob("part-*.parquet"))) == 3
    get = paged.bucket_fetch(f"file://{tmp_path}/api", 3)
    assert [get("q 9", k) for k in (1, 2, 3, 4)] == [FULL, NONE, FULL, None] and get("other", 1) is None
    monkeypatch.setattr(paged, "PARTITIONS", 8)
    got = paged.fetched_pages(spark, get, [f"q {i}" for i in range(41)], name="paged_buckets")
    assert len(paged._dealt([f"q {i}" for i in range(41)])) <= 8
    assert sorted((r.query, r.page) for r in got.collect()) == sorted((q, k) for q, k, v in rows if v == FULL and (q, k) != ("q 7", 3))


def test_state_expires(spark, tmp_path):
    """Sightings renew a key; a key that was away for longer is new again, and its state is gone from the store."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(hours=h)) for h, k in [(0, "a"), (1, "b"), (5, "a"), (6, "c"), (11, "a"), (30, "a"), (31, "d"), (32, "d"), (90, "b"), (91, "e")]]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.STORE)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = state.first_seen_expiring(stream, ["k"], "ts", 6 * 3600).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.set(key, before)
    assert got == sorted(map(tuple, state.revisits(df, ["k"], "ts", 6 * 3600).collect())) and len(got) == 7
    assert held < 5


def test_keys_share_state(spark, tmp_path):
    """State is one value for each bucket of keys, null ones included, and a stream goes on from its checkpoint with it."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(None if k == 7 else k, "a:" if k % 2 else None, start + datetime.timedelta(hours=h, microseconds=k)) for k in range(200) for h in ((0, 20) if k % 3 else (0, 3, 20))]
    df = spark.createDataFrame(rows, "k bigint, l string, ts timestamp")
    with drivers._store(spark):
        for low, high in ((0, 10), (10, 30)):
            df.filter(F.hour("ts").between(low, high)).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
            query = state.first_seen_expiring(stream, ["k", "l"], "ts", 18 * 3600, buckets=3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            query.awaitTermination()
    got = sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(str, state.revisits(df, ["k", "l"], "ts", 18 * 3600).collect())) and len(got) > 300
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 3  # a value and its timer


def test_counted_writes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "[MASK] a. b c. d"), (2, "x y. z [MASK]"), (3, "no mask. here"), (4, "[MASK]"), (5, None)], "id int, text string")
    cut = lambda df: models.truncated(df, "text", lambda ts: [len(t.split()) for t in ts], 2, lambda t: t.split(". "))
    got = counted.build_training(rows, lambda df: df.write.parquet(f"{tmp_path}/t"), cut)
    assert got == {"n_in": 5, "n_out": 3, "n_skipped": 2, "n_truncated": 2}
    assert {r.id: r.text for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {1: "[MASK] a", 2: "z [MASK]", 4: "[MASK]"}
    docs = spark.createDataFrame([(1, "Mă simt bine. Altceva."), (2, "Azi. Mă simt bine."), (3, "Nimic aici."), (4, "scurt"), (5, None)], "id int, text string")
    words = spark.createDataFrame([("bine", False, ["joy"])], "word string, noun boolean, emotions array<string>")
    got = counted.extract(docs, words, lambda df: df.write.parquet(f"{tmp_path}/x"), least=6)
    assert {k: got[k] for k in ("n_scanned", "n_too_short", "n_no_match", "n_matched", "n_matches", "n_duplicates", "n_kept", "match_rate")} == {"n_scanned": 5, "n_too_short": 2, "n_no_match": 1, "n_matched": 2, "n_matches": 2, "n_duplicates": 1, "n_kept": 1, "match_rate": 40.0}
    (r,) = spark.read.parquet(f"{tmp_path}/x").collect()
    assert (r.id, r.matched_sentence, r.seed) == (1, "Mă simt bine.", "bine")


def test_extraction_compares_places_not_sentences(spark, tmp_path):
    """Sentences as long as their texts don't enter the comparison of a key's matches; null ids and repeated ones hold their place."""
    words = spark.createDataFrame([("bine", False, ["joy"]), ("rau", False, ["fear"])], "word string, noun boolean, emotions array<string>")
    docs = spark.createDataFrame([(2, "ma simt rau " * 50), (1, "ma simt bine " * 50), (1, "ma simt bine " * 50), (None, "nu ma simt rau"), (3, "scurt")], "id int, text string")
    plans = []

    def write(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        df.write.parquet(f"{tmp_path}/x")

    got = counted.extract(docs, words, write, F.concat_ws("|", "pattern", "seed"), least=6, most=None)
    assert (got["n_scanned"], got["n_too_short"], got["n_matched"], got["n_matches"], got["n_kept"], got["n_duplicates"]) == (5, 1, 4, 151, 2, 149)
    rows = {r.seed: (r.id, r.start, r.matched_sentence) for r in spark.read.parquet(f"{tmp_path}/x").collect()}
    assert rows == {"bine": (1, 0, ("ma simt bine " * 50).strip()), "rau": (None, 3, "nu ma simt rau")}
    assert "min_by" not in plans[0] and "max_by" not in plans[0]


def test_truncation_equals_dropping_one_by_one(spark):
    def brute(text, most):
        parts, end = text.split(". "), True
        if len(text.split()) <= most:
            return text
        while len(parts) > 1 and len(" ".join(parts).split()) > most:
            own = next((i for i, p in enumerate(parts) if "[MASK]" in p), None)
            last, first = own is None or own < len(parts) - 1, own is None or own > 0
            parts = parts[:-1] if (end and last) or not first else parts[1:]
            end = not end
        return " ".join(parts)

    rng = random.Random(2)
    texts = [". ".join(" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    for i in range(0, 60, 2):
        at = rng.randrange(len(texts[i]) + 1)
        texts[i] = f"{texts[i][:at]} [MASK] {texts[i][at:]}"
    calls = []
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = {r.i: r.text for r in models.truncated(df, "text", lambda ts: [len(t.split()) for t in ts], 20, lambda t: t.split(". ")).collect()}
    assert got == {i: brute(t, 20) for i, t in enumerate(texts)} and not calls


def test_ranked_values(spark):
    rng = random.Random(1)
    for values in ([rng.randrange(50) for _ in range(301)], [rng.gauss(0, 1) * 10 ** rng.randrange(-200, 200) for _ in range(200)], [1.5] * 9, [-1e308, 1e308, 0.0, 5e-324, -5e-324], [7.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        n, got = corpus.ranked_values(df, "v", lambda n: [0, n // 3, n // 2, n - 1])
        assert n == len(values) and got == {k: sorted(values)[k] for k in {0, n // 3, n // 2, n - 1}}
    assert corpus.linear_percentiles(df.limit(0), "v", [0.5]) == [None]
    df = spark.createDataFrame([(float(v),) for v in range(10)], "v double")
    assert corpus.linear_percentiles(df, "v", [0.05, 0.5, 0.95]) == pytest.approx(list(np.percentile(range(10), [5, 50, 95])))


def test_completions_to_metrics(spark):
    rows = [("p1", "Joy", "x", ["t"]), ("p2", "fear", "y", ["t", "u"]), ("p3", "none", "x", None)]
    df = spark.createDataFrame(rows, "prompt string, gold string, source string, tags array<string>").withColumn("gold", F.lower("gold"))
    said = {"p1": [("sad", 0.1), ("Joy!", 0.9), ("joy", 0.5)], "p2": [("a", 3), ("b", 2), ("Fear", 1)], "p3": []}
    done = metrics.predicted(models.completed(df, "prompt", lambda ps: [said[p] for p in ps]), "completions", 3)
    assert {r.prompt: r.predictions for r in done.collect()} == {"p1": ["joy", "sad", ""], "p2": ["a", "b", "fear"], "p3": ["", "", ""]}
    got = {(r.dimension, r.key): (r.n, r.acc_at_1, r.acc_at_3, round(r.mrr, 4)) for r in metrics.ranking_breakdowns(done, "predictions", "gold", "source", "tags").collect()}
    assert got == {("all", None): (3, 1 / 3, 2 / 3, round(4 / 9, 4)), ("source", "x"): (2, 0.5, 0.5, 0.5), ("source", "y"): (1, 0.0, 1.0, 0.3333), ("tags", "t"): (1, 1.0, 1.0, 1.0), ("tags", "t,u"): (1, 0.0, 1.0, 0.3333), ("tags", "unknown"): (1, 0.0, 0.0, 0.0)}


def test_models_get_bounded_prompts(spark, monkeypatch):
    """However many rows a batch has, a model's hook gets few characters at a time; replies stay with their rows."""
    monkeypatch.setattr(models, "PROMPT_CHARS", 1000)
    df = spark.range(500, numPartitions=1).select("id", F.when(F.col("id") % 9 > 0, F.repeat(F.lit("x"), (F.col("id") % 400).cast("int"))).alias("p"))
    sized = lambda ps: [f"{len(p)} {sum(map(len, ps))}" for p in ps]
    got = {r.id: tuple(map(int, r.raw.split())) for r in models.generated(df, "p", sized).collect()}
    assert len(got) == 500 and all(n == (i % 400 if i % 9 else 0) and whole <= 1000 for i, (n, whole) in got.items())
    got = {r.id: r.completions for r in models.completed(df, "p", lambda ps: [[(f"{len(p)}", sum(map(len, ps)))] for p in ps]).collect()}
    assert len(got) == 500 and all(int(c[0].text) == (i % 400 if i % 9 else 0) and c[0].score <= 1000 for i, c in got.items())


def test_top_words(spark):
    weighed = spark.createDataFrame([("a", 3.0), ("b", -2.0), ("c", 1.0), ("d", 3.0), ("e", -5.0)], "word string, weight double")
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "word string")
    assert sorted((r.place, r.word) for r in models.top_words(weighed, known, 2).collect()) == [(-2, "c"), (-1, "b"), (1, "a"), (2, "d")]


def test_word_weights_of_any_vocabulary(spark, tmp_path):
    """Words that are rarer than the first 2^18 count, too."""
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    many, rare = [letters(i) for i in range(1_000_000, 1_270_000)], [f"zzz{letters(i)}" for i in range(10, 30)]
    docs = [(0, " ".join(many)), (1, " ".join(many)), (2, " ".join(rare))]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.place: (r.word, r.weight) for r in catalog.queries()["top_model_words"](spark, str(tmp_path)).collect()}
    v = len(many) + len(rare)
    weight = math.log(2 / (len(rare) + v)) - math.log(1 / (2 * len(many) + v))
    assert len(got) == 40 and [got[i][0] for i in range(1, 21)] == sorted(rare) and got[1][1] == pytest.approx(weight, abs=1e-8)


def test_video_plan(spark):
    hits = spark.createDataFrame([("q", i % 9, i) for i in range(40)] + [("r", 3, 1), ("r", 3, 0)], "query string, video_id int, place int")
    videos = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(8)], "video_id int, channel_name string, views int")
    chosen, channels = corpus.video_plan(hits, videos, F.col("views") > 0, 3)
    assert sorted((r.query, r.video_id) for r in chosen.collect()) == [("q", i) for i in range(1, 6)] + [("r", 3)]
    assert {r.channel_name: (r.n, r.queries) for r in channels.collect()} == {"a": (2, 1), "b": (4, 2)}


def test_sources_in_turn(spark, tmp_path):
    good = spark.createDataFrame([("bun", "joy")], "word string, category string")

    def reading(path):
        return lambda: spark.read.schema("word string, category string").json(path)

    good.write.json(f"{tmp_path}/good")
    good.limit(0).write.json(f"{tmp_path}/empty")
    spark.createDataFrame([("bun", None)], good.schema).write.json(f"{tmp_path}/unset")
    bad = [("none", reading(f"{tmp_path}/none")), ("empty", reading(f"{tmp_path}/empty")), ("unset", reading(f"{tmp_path}/unset"))]
    for k in range(4):  # the good one in each place
        sources = [*bad[:k], ("good", reading(f"{tmp_path}/good")), *bad[k:]]
        name, rows = lexicon.first_source(sources, ["word", "category"])
        assert name == "good" and [tuple(r) for r in rows.collect()] == [("bun", "joy")]
    with pytest.raises(LookupError):
        lexicon.first_source(bad, ["word", "category"])


def test_frames_with_blanks_inside_groups(spark):
    frame = r"de\s+(?:a\s+fi|fost)"
    docs = spark.createDataFrame([(1, "de a fi trist și de  fost bine, de fi bine")], "id int, text string")
    words = spark.createDataFrame([("trist", False, ["s"]), ("bine", False, ["j"])], "word string, noun boolean, emotions array<string>")
    found = {s: sorted((r.start, r.end, r.seed) for r in patterns.find_matches(docs, words, templates=(patterns.Template("x", "primary", frame),), strategy=s).collect()) for s in ("tokens", "regex")}
    assert found["tokens"] == found["regex"] and len(found["regex"]) == 2


def test_best_of_posts(spark):
    rng = np.random.default_rng(2)
    x, a = rng.normal(size=(60, 5)), rng.normal(size=(33, 5))
    rows = spark.createDataFrame([(i, i % 7, v) for i, v in enumerate(x.tolist())], "k bigint, post int, v array<double>")
    anchors = spark.createDataFrame(list(enumerate(a.tolist())), "k bigint, v array<double>")
    s = x @ a.T
    want = {p: max((s[i].max(), -i, -s[i].argmax()) for i in range(60) if i % 7 == p) for p in range(7)}
    got = vector.post_best(rows, anchors, "k", "v", "k", "post").collect()
    assert {r.post: (-r.k, -r.anchor) for r in got} == {p: w[1:] for p, w in want.items()} and all(math.isclose(r.similarity, want[r.post][0]) for r in got)
    near = {r.k: r.anchor for r in vector.nearest_blocked(rows, anchors, "k", "v", "k", 4, 7).collect()}
    assert near == {i: int(s[i].argmax()) for i in range(60)}
    sentences = spark.createDataFrame([("a",), ("b",), ("a",)], "matched_sentence string")
    assert sorted(r.sentence for r in vector.distinct_anchors(sentences).collect()) == ["a", "b"]
