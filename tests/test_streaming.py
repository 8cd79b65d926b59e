from pyspark.sql import functions as F

from lexloom.operators import corpus
from lexloom.streaming import crawl

SCHEMA = "id int, key string, text string, ts timestamp"


def landed(spark, tmp_path):
    rows = [(i, f"k{i % 7}", "mă simt bine " * (i % 5 * 4), i * 600) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, key string, text string, t long").select("id", "key", "text", F.timestamp_seconds("t").alias("ts"))
    for i in range(3):
        df.filter(F.col("id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df


def drain(stream, tmp_path, mode="append"):
    out = f"{tmp_path}/out-{mode}"

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/c-{mode}").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return stream.sparkSession.read.parquet(out)


def test_stream_equals_batch(spark, tmp_path):
    df = landed(spark, tmp_path)
    source = lambda: crawl.file_stream(spark, f"{tmp_path}/in", SCHEMA, files=1)
    seen = drain(crawl.first_seen(source().select("key"), ["key"]), tmp_path)
    assert sorted(r.key for r in seen.collect()) == sorted({r.key for r in df.collect()})
    rules = corpus.crawl_rules(F.col("text"), None, shortest=100)
    got = drain(crawl.reason_counts(source(), rules), tmp_path, "complete")
    last = got.filter(F.col("batch") == got.agg(F.max("batch")).first()[0])
    assert {(r.reason, r.n) for r in last.collect()} == {(r.reason, r.n) for r in corpus.reasons(df, rules).collect()}


def test_stop_and_resume(spark, tmp_path):
    landed(spark, tmp_path)
    stream = crawl.file_stream(spark, f"{tmp_path}/in", SCHEMA, files=1)
    first = crawl.collect_until(stream, f"{tmp_path}/o", f"{tmp_path}/ck", 10)
    assert 10 <= first < 60
    assert crawl.collect_until(stream, f"{tmp_path}/o", f"{tmp_path}/ck", 1000) == 60


def test_windows_and_sessions(spark, tmp_path):
    df = landed(spark, tmp_path)
    source = crawl.file_stream(spark, f"{tmp_path}/in", SCHEMA)
    got = drain(crawl.windowed_counts(source, "ts", ["key"], "2 hours"), tmp_path, "update")
    want = df.groupBy(F.window("ts", "2 hours").alias("w"), "key").count()
    assert got.agg(F.sum("n")).first()[0] == want.agg(F.sum("count")).first()[0] == 60
    assert crawl.sessions(source, "ts", "key").columns == ["key", "start", "end", "n"]
