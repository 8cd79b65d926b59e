import glob
import os
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexloom.plans import catalog, files

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def shown(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return repr(list(v))
    if pd.isna(v):
        return "null"
    v = v.item() if hasattr(v, "item") else v
    return repr(round(float(v), 6)) if isinstance(v, int | float) and not isinstance(v, bool) else repr(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(shown, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bootstrapped_lexicon_runs_four_rounds(spark, tmp_path):
    chain = ["onek", "twok", "threek", "fourk", "fivek", "sixk"]
    pairs = [("that", "onek"), ("with", "onek"), ("that", "lonek")] + [p for a, b in zip(chain, chain[1:], strict=False) for p in ((a, b), ("that", b))]
    texts = [f"Say {('the', 'of', 'is')[i % 3]} {x} and {y}." for i, (x, y) in enumerate(pairs)]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    want = set(catalog.SEEDS)
    for _ in range(4):
        found = {}
        for t in texts:
            x, y = re.search(r"(?:the|of|is) ([a-z]+) and ([a-z]+)", t).groups()
            if x in want:
                found.setdefault(y, set()).add(x)
        want |= {y for y, xs in found.items() if len(xs) >= 2}
    got = catalog.queries()["bootstrapped_lexicon"](spark, str(tmp_path)).collect()
    assert want == {*catalog.SEEDS, *chain[:4]} and sorted(r.word for r in got) == sorted(want)


def test_verified_spans_counts_all_matches_of_a_document(spark, tmp_path):
    text = "the and " * 150 + "of that"
    pd.DataFrame({"doc_id": [1], "text": [text]}).to_parquet(tmp_path / "documents.parquet")
    got = {r.pattern_used: r.ok + r.failed for r in catalog.queries()["verified_spans"](spark, str(tmp_path)).collect()}
    assert got == {"the_state": len(re.findall("the and", text)), "of_state": 1}


def test_layout_of_hard_rows(spark, tmp_path):
    """Short rows that much work is done on are dealt; verified spans join nothing, and a word's gender is worked out after counting."""
    rows = spark.range(3).select(F.col("id").alias("c_custkey"), F.lit("C").alias("c_name"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert catalog._customers(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    spark.createDataFrame([(1, "the that, the that of it"), (1, "the and")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    checked = catalog.queries()["verified_spans"](spark, str(tmp_path))
    assert {r.pattern_used: (r.ok, r.failed, r.masked) for r in checked.collect()} == {"the_state": (3, 0, 3), "of_state": (1, 0, 1)}
    words = catalog.queries()["word_genders"](spark, str(tmp_path))
    assert re.search(r"Aggregate \[word#\d+\],", words._jdf.queryExecution().optimizedPlan().toString())


def test_context_windows_in_bounded_pieces(spark, tmp_path, monkeypatch):
    """The tasks that cut windows are of bounded size, so more documents make more tasks, not longer ones."""
    rows = spark.range(64).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words and "), F.sha2(F.col("id").cast("string"), 512), F.lit(" more")).alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(files, "WINDOW_BYTES", 1 << 9)
    got = catalog.queries()["context_windows"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert got.count() == 64 and {r.matched for r in got.collect()} == {"and sentence."}
