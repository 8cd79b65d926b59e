import zlib

import numpy as np
import pytest

from lexloom.llm import labelled, quality, toxicity

DATA = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, "x" * 300_000), (4, "word " * 50_000), (5, "\n\n"), (6, "twice"), (6, "twice"), (None, "no id"), (7, "😀 ñandú")]


def auc(y, s):
    a, b = s[y == 1], s[y == 0]
    return np.mean((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :]))


@pytest.mark.parametrize(("query", "column", "least"), [(quality.op2_quality, "quality", 0.97), (toxicity.op10_toxicity, "toxic", 0.8)])
def test_held_out_documents(spark, query, column, least):
    got = query(spark, DATA).toPandas()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]
    assert got["score"].between(0, 1).all()
    rows = got[got["held_out"]].merge(spark.read.parquet(f"{DATA}/labels.parquet").toPandas(), on="doc_id")
    assert auc(rows[column].to_numpy(), rows["score"].to_numpy()) >= least
    assert (rows["predicted"] == rows[column]).mean() >= 0.93


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity])
def test_edges(docs_of, spark, score):
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 2)) for i in range(8)] + [(None, 1, 1), (3, None, None), (3, 1, 1), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    none = labels.filter("false")
    for known in (labels, none, labels.select("doc_id", *[(labels[c] * 0).alias(c) for c in ("quality", "toxic")])):
        got = score(docs_of(EDGES, extra=True), known).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in EDGES)
        assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 6}) == 1
        assert {r.score for r in got if r.doc_id in (1, 2)} == {next(r.score for r in got if r.doc_id == 1)}
        assert score(docs_of([]), known).collect() == []
    df = docs_of(EDGES, extra=True)
    assert quality.keep_quality(df, labels).columns == df.columns


def test_sample_is_bounded_and_leaves_fold_0_out(docs_of, spark):
    docs = docs_of([(i, f"text {i}") for i in range(2000)])
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "doc_id bigint, quality int")
    got = labelled.sample(docs, labels, "quality", 200).collect()
    assert 60 <= sum(r.y for r in got) <= 150 and 60 <= sum(1 - r.y for r in got) <= 150
    assert all(r.fold == zlib.crc32(r.text[5:].encode()) % 5 != 0 for r in got)
    whole = sum(r.weight for r in got if not r.y)
    assert abs(whole - 1440) < 300


def test_pool_adjacent_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = rng.integers(1, 9)
        w, m = rng.uniform(0.1, 3, n), rng.normal(size=n)
        got = quality.pool_adjacent(w, m)
        best = [max(min(np.average(m[a : b + 1], weights=w[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(got, best)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, len(quality.STATISTICS)))
    z = quality.fourier(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * len(quality.STATISTICS)))
    assert np.abs(z @ z.T - exact).mean() < 0.08


def test_statistics_read_the_whole_text():
    a, b = quality.statistics(b"word " * 40_000), quality.statistics(b"word " * 40_000 + b"END!!")
    assert a[6] == 0 and b[6] > 0 and np.isfinite(quality.statistics(b"")).all()


def test_chain_feeds_earlier_probabilities(docs_of, spark):
    rows = [(i, f"w{i} good plain {'vile0' if i % 4 == 0 else ''} {'awful9' if i % 8 == 0 else ''} end", "en" if i % 8 == 0 else "fr") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs_of(rows), labels)
    assert model.categories == ["toxic_en", "toxic_fr", "toxic"] and b"vile0" in model.index
    assert [len(w) for w in model.weights] == [len(model.index) + k + 1 for k in range(3)]
    texts = [model.hits(t.encode()) for t in ("plain words", "a vile0, thing", "vile0 AWFUL9!")]
    p = model.probabilities(texts)
    assert p[0].max() < 0.1 and p[1][2] > 0.9 < p[2][2] and p[2][0] > 0.5 > p[1][0]
    assert np.abs(model.weights[2][len(model.index) : -1]).min() > 1e-3  # the score hangs on the links before it
    model.weights[0] = model.weights[0] * 0
    assert not np.allclose(model.probabilities(texts)[:, 2], p[:, 2])


def test_chain_against_a_dense_one(docs_of, spark, monkeypatch):
    """The same rules in memory: counts by dictionaries, all rows apart, models by plain gradient descent."""
    monkeypatch.setattr(toxicity, "TERMS", 8)
    monkeypatch.setattr(toxicity.fit, "__defaults__", ("toxic", toxicity.TRAIN_ROWS, 8))
    rng = np.random.default_rng(5)
    words, bad = [f"{c}{c}{i}" for i in range(9) for c in "abc"], ["vile", "awful", "dreck"]
    rows = []
    for i in range(240):
        toxic = i % 3 == 0
        text = " ".join([*rng.choice(words, 6), *(rng.choice(bad[: 2 + i % 2], 2) if toxic or rng.random() < 0.05 else [])])
        rows.append((i, text, "en" if i % 2 else "de", int(toxic)))
    model = toxicity.fit(docs_of([r[:3] for r in rows]), spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int"))
    train = {}
    for i, text, lang, y in rows:
        f = zlib.crc32(str(i).encode()) % 5
        if f:
            train[text] = max(train.get(text, (-1,)), (y, f, 1.0, lang))
    texts, (ys, folds, _, langs) = list(train), map(np.array, zip(*train.values()))
    held = [toxicity.terms(t.encode()) for t in texts]

    def best(inside):
        n, m = (ys[inside] == 1).sum(), (ys[inside] == 0).sum()
        scored = []
        for term in set().union(*(held[k] for k in inside)):
            have = np.array([term in held[k] for k in inside])
            a, b = have[ys[inside] == 1].sum(), have[ys[inside] == 0].sum()
            p, q = a / n, b / m
            if a >= toxicity.LEAST and p > 4 * q:
                scored.append((-(p - q) / np.sqrt(p * (1 - p) / n + q * (1 - q) / m + 1e-9), term))
        return [t for _, t in sorted(scored)[:8]]

    def descend(x, y):
        w, rate = np.zeros(x.shape[1]), np.array([toxicity.RIDGE] * (x.shape[1] - 1) + [1e-6])
        for _ in range(30_000):
            g = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) + rate * w
            w -= g / (len(x) * x.shape[1] / 8 + 1)
        return w

    dense = lambda terms: np.array([[float(t in h) for t in terms] for h in held])
    logit, one = lambda p: np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3))), np.ones((len(texts), 1))
    whole, earlier = best(np.arange(len(texts))), np.zeros((len(texts), 0))
    assert list(model.index) == whole
    for k, y in enumerate([ys * (langs == c.split("_")[1]) if "_" in c else ys for c in model.categories]):
        assert np.allclose(model.weights[k], descend(np.hstack([dense(whole), logit(earlier), one]), y), atol=0.02), k
        out = np.zeros(len(texts))
        for f in np.unique(folds):
            inside, outside = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
            x = np.hstack([dense(best(outside)), logit(earlier), one])
            out[inside] = 1 / (1 + np.exp(-(x[inside] @ toxicity.logistic(x[outside], y[outside], np.ones(len(outside))))))
        earlier = np.hstack([earlier, out[:, None]])


def test_quality_against_a_dense_fit(spark):
    """The same model in memory: one matrix, one solve, and the least-squares monotone fit, over all documents of the small table."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").toPandas() for t in ("documents", "labels"))
    got = quality.op2_quality(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    x = np.stack([quality.statistics((t or "").encode()) for t in docs["text"]])
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in docs["doc_id"]])
    label = docs["doc_id"].map(labels.set_index("doc_id")["quality"]).to_numpy(float)
    known = ~np.isnan(label) & (fold != 0)
    z = quality.fourier((x - x[known].mean(axis=0)) / np.maximum(x[known].std(axis=0), 1e-6))
    own = known & (fold != 1)
    a = z[own].T @ z[own]
    raw = z @ np.linalg.solve(a + quality.RIDGE * max(1.0, np.trace(a) / len(a)) * np.eye(len(a)), z[own].T @ label[own])
    at = np.flatnonzero(known & (fold == 1))
    bins = np.floor(np.clip(raw[at], -1, 2) * 500)
    keys = np.unique(bins)
    n = np.array([(bins == k).sum() for k in keys])
    mean, center = (np.array([v[at][bins == k].mean() for k in keys]) for v in (label, raw))
    sums = lambda v, i, j: (n[i : j + 1] * v[i : j + 1]).sum() / n[i : j + 1].sum()
    fitted = np.array([max(min(sums(mean, i, j) for j in range(k, len(keys))) for i in range(k + 1)) for k in range(len(keys))])
    values = np.unique(fitted.round(12))
    knots = [np.average(center[np.isclose(fitted, v)], weights=n[np.isclose(fitted, v)]) for v in values]
    expected = 0.999 * np.interp(raw, knots, values) + 0.001 * np.clip(raw, 0, 1)
    assert np.allclose(got.loc[docs["doc_id"], "score"], expected, atol=1e-6)
    assert (got.loc[docs["doc_id"], "predicted"].to_numpy() == (expected >= 0.3)).all()


def test_ids_that_are_no_numbers_have_no_label(spark):
    docs = spark.createDataFrame([("a", "text", "en"), ("7", "other", "en"), (None, None, None)], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([(7, 1, 1), (8, 0, 0)], "doc_id bigint, quality int, toxic int")
    for score in (quality.quality_scores, toxicity.toxicity):
        assert sorted(str(r.doc_id) for r in score(docs, labels).collect()) == ["7", "None", "a"]
        assert score(docs.drop("lang"), labels).count() == 3


def test_labels_by_text_ids(spark, docs_of):
    """Text ids select the labelled documents that numbers select."""
    rows = [(i, f"text {i}") for i in range(40)]
    known = spark.createDataFrame([(i, i % 2) for i in range(0, 40, 2)], "doc_id bigint, quality int").withColumn("quality", (quality.F.col("doc_id") % 4 == 0).cast("int"))
    text = lambda df: df.withColumn("doc_id", df["doc_id"].cast("string"))
    chosen = lambda docs, ls: sorted((r.text, r.y, r.fold) for r in labelled.sample(docs, ls, "quality", 1000).collect())
    want = chosen(docs_of(rows), known)
    assert len(want) > 10 and chosen(text(docs_of(rows)), known) == chosen(text(docs_of(rows)), text(known)) == want
    named = docs_of(rows).withColumn("doc_id", quality.F.concat(quality.F.lit("id-"), "doc_id"))
    labels = known.withColumn("doc_id", quality.F.concat(quality.F.lit("id-"), "doc_id"))
    assert len(chosen(named, labels)) > 10
