"""Queries of whole drivers: paged collection, counted writes, evaluation chains, streams over several batches. See ``catalog``."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, lexicon, metrics, models, vector
from ..scratch import scratch
from ..sources import counted, paged, readers
from ..streaming import crawl, state
from .catalog import _FOLD, _MATCH_SQL, FRAMES, _folded, _lexicon, _read, query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


# --- Collection

_PAGED_SQL = """WITH p AS (SELECT page_id // 50 AS q, page_id % 50 + 1 AS page, length(html) % 3 = 0 AS blank, page_id, url FROM pages),
n AS (SELECT *, row_number() OVER w AS i, lag(blank) OVER w AS before FROM p WINDOW w AS (PARTITION BY q ORDER BY page)),
s AS (SELECT q, min(page) AS stop FROM n WHERE page <> i OR page > 40 OR (blank AND before) GROUP BY q)
SELECT 'q' || q AS query, 'v' || page_id AS video_id, url AS full_context FROM p LEFT JOIN s USING (q) WHERE NOT blank AND (stop IS NULL OR page < stop)"""


@query(_PAGED_SQL)
def paged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12, SRC-13: a paged API as a data source: each query's pages until two empty ones in a row, flattened to hits.

    The table pages plays the API: fifty rows answer a query, a page each, and lie in the shared folder, in a file for many queries, from
    which tasks fetch.
    """
    folder, rows = _folder(spark, "api"), _read(spark, sf_dir, "pages")
    hit = F.struct(F.lit("1.5").alias("start"), F.lit("1").alias("dur"), F.lit("").alias("ctx_before"), F.col("url").alias("token"), F.lit("").alias("ctx_after"))
    video = F.array(F.struct(F.concat(F.lit("v"), "page_id").alias("id"), F.col("url").alias("title"), F.array(hit).alias("hits")))
    found = F.when(F.length("html") % 3 == 0, F.slice(video, 1, 0)).otherwise(video)
    landed = rows.select(F.concat(F.lit("q"), F.expr("page_id div 50")).alias("query"), (F.col("page_id") % 50 + 1).alias("page"), F.to_json(F.struct(found.alias("result"))).alias("value"))
    buckets = readers.pieces(landed)
    paged.land(landed, folder, buckets)
    asked = landed.select("query", paged.bucket_of(F.col("query"), buckets).alias("bucket")).distinct().orderBy("bucket", "query")
    names = [r["query"] for r in asked.collect()]  # the list of searches is a parameter
    pages = paged.fetched_pages(spark, paged.bucket_fetch(folder, buckets), names, most=40)
    return readers.subtitle_hits(pages.select("query", readers.parsed_page(F.col("body")).alias("p")).select("query", "p.*")).select("query", "video_id", "full_context")


_VIDEO_SQL = """WITH d AS (SELECT event_type, user_id, min(event_id) AS place FROM events GROUP BY ALL), c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY place, user_id) <= 100)
SELECT c_mktsegment AS channel, count(*) AS n, count(DISTINCT event_type) AS queries FROM c JOIN customer ON user_id = c_custkey WHERE c_acctbal >= 1000 GROUP BY 1"""


@query(_VIDEO_SQL)
def video_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEP-09, FLT-11, JOIN-16: distinct videos of each search, at most twice the limit, filtered by their metadata; counts by channel. Events play hits."""
    hits = _read(spark, sf_dir, "events").select(F.col("event_type").alias("query"), F.col("user_id").alias("video_id"), F.col("event_id").alias("place"))
    videos = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_mktsegment").alias("channel"), F.col("c_acctbal").alias("views"))
    keep = readers.video_filter(F.col("views"), F.lit(None).cast("int"), least_views=1000, shortest=60)
    return corpus.video_plan(hits, videos, keep, 50, channel="channel")[1]


@query("SELECT DISTINCT 'cleaned' AS source, lower(p_brand) AS word, min(p_type) AS category FROM part GROUP BY p_brand")
def seed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEP-05: a lexicon from the first of four sources that is there: here the cached JSON is missing and the CSV has no rows."""
    folder = _folder(spark, "seeds")
    words = _read(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("word")).agg(F.min("p_type").alias("category"))
    words.filter("false").write.option("header", True).csv(f"{folder}/empty")
    words.write.json(f"{folder}/cleaned")
    name, found = lexicon.first_source(
        [
            ("cached", lambda: readers.lexicon_json(spark, f"{folder}/none.json")),
            ("table", lambda: spark.read.schema("word string, category string").option("header", True).csv(f"{folder}/empty")),
            ("cleaned", lambda: spark.read.schema("word string, category string").json(f"{folder}/cleaned")),
            ("first", lambda: words.limit(1)),
        ],
        ["word", "category"],
    )
    return found.select(F.lit(name).alias("source"), "word", "category")


# --- Counted writes

_EXTRACT_SQL = f"SELECT (SELECT count(*) FROM documents) AS n_scanned, (SELECT count(*) FROM documents WHERE length({_FOLD}) < 60) AS n_too_short, (SELECT count(*) FROM documents WHERE length({_FOLD}) >= 60) - count(DISTINCT doc_id) AS n_no_match, count(DISTINCT doc_id) AS n_matched, count(*) AS n_matches, count(*) - count(DISTINCT (pattern, seed)) AS n_duplicates, count(DISTINCT (pattern, seed)) AS n_kept, 100.0::DOUBLE * count(DISTINCT doc_id) / (SELECT count(*) FROM documents) AS match_rate, count(DISTINCT (pattern, seed)) AS written FROM ({_MATCH_SQL}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE length({_FOLD}) >= 60)"


@query(_EXTRACT_SQL)
def counted_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEP-02, DEP-08, PRJ-13: matches written without repeats (of template and seed), with the counts that one pass observes, beside the rows that are there."""
    path = _folder(spark, "extracted")
    counts = counted.extract(_folded(spark, sf_dir), _lexicon(spark), lambda df: df.write.parquet(path), F.concat_ws("|", "pattern", "seed"), 60, templates=FRAMES, most=None, modifier="")
    names = ("n_scanned", "n_too_short", "n_no_match", "n_matched", "n_matches", "n_duplicates", "n_kept", "match_rate")
    return spark.read.parquet(path).agg(*[F.lit(counts[n]).alias(n) for n in names], F.count(F.lit(1)).alias("written"))


#: Tokens of the truncation queries: words between single blanks.
MOST_TOKENS = 200


def _words_in(texts: list[str]) -> list[int]:
    return [x.count(" ") + 1 for x in texts]


def _pieces(text: str) -> list[str]:
    return text.split(". ")


_CUT_SQL = """s AS (SELECT doc_id, x, string_split(x, '. ') AS s FROM t), c AS (SELECT *, list_transform(s, lambda p: len(p) - len(replace(p, ' ', '')) + 1) AS c, len(x) - len(replace(x, ' ', '')) + 1 AS n FROM s),
j AS (SELECT *, CASE WHEN n > 200 THEN coalesce(list_filter(range(len(s)), lambda j: list_sum(c[{low} : {high}]) <= 200)[1], len(s) - 1) END AS j FROM c)"""


@query(f"WITH t AS (SELECT doc_id, text AS x FROM documents), {_CUT_SQL.format(low='j // 2 + 1', high='len(s) - (j + 1) // 2')} SELECT doc_id, md5(CASE WHEN j IS NULL THEN x ELSE array_to_string(s[j // 2 + 1 : len(s) - (j + 1) // 2], ' ') END) AS cut FROM j")
def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-35: whole texts cut to 200 tokens by dropping sentences from the end and the start in turn."""
    docs = readers.spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return models.truncated(docs, "text", _words_in, MOST_TOKENS, _pieces).select("doc_id", F.md5(F.col("text").cast("binary")).alias("cut"))


@query(f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE '[MASK] ' || text END AS x FROM documents), {_CUT_SQL.format(low='1', high='len(s) - j')} SELECT count(*) AS n_in, count(*) FILTER (WHERE doc_id % 5 <> 0) AS n_out, count(*) FILTER (WHERE doc_id % 5 = 0) AS n_skipped, count(*) FILTER (WHERE doc_id % 5 <> 0 AND j > 0) AS n_truncated, (sum(CASE WHEN doc_id % 5 = 0 THEN 0 WHEN j IS NULL THEN len(x) ELSE len(array_to_string(s[1 : len(s) - j], ' ')) END))::BIGINT AS written FROM j")
def counted_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-13, PRJ-12, TXT-35: training rows written after truncation, with counts of rows in, out, skipped and truncated; the mask stays."""
    path = _folder(spark, "training")
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.concat(F.lit(f"{T.MASK} "), "text")).alias("text"))
    counts = counted.build_training(readers.spread(docs), lambda df: df.write.parquet(path), lambda df: models.truncated(df, "text", _words_in, MOST_TOKENS, _pieces))
    return spark.read.parquet(path).agg(*[F.lit(counts[n]).alias(n) for n in ("n_in", "n_out", "n_skipped", "n_truncated")], F.sum(F.length("text")).alias("written"))


# --- Evaluation


def _longest_first(prompts: list[str]) -> list[list[tuple[str, float]]]:
    """A stand-in for a model: the prompt's words are its completions, scored by their length."""
    return [[(w, float(len(w))) for w in re.sub("[^a-z ]", "", p.lower()).split(" ") if w] for p in prompts]


_COMPLETED_SQL = """WITH w AS (SELECT conv_id, turn, role, list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' '), lambda x: x <> '') AS ws FROM conversations),
u AS (SELECT *, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS us FROM w),
p AS (SELECT role, (turn % 3)::VARCHAR AS third, ws[3] AS g, list_transform(list_sort(list_transform(us, lambda x, i: {'n': -len(x), 'i': i, 'x': x})), lambda s: s.x)[1:5] AS p FROM u),
h AS (SELECT role, third, coalesce(list_contains(p[1:1], g), false)::INT a1, coalesce(list_contains(p[1:3], g), false)::INT a3, coalesce(list_contains(p, g), false)::INT a5, coalesce(1.0::DOUBLE / nullif(list_position(p, g), 0), 0.0::DOUBLE) rr FROM p)
SELECT CASE WHEN grouping(role) = 0 THEN 'role' WHEN grouping(third) = 0 THEN 'third' ELSE 'all' END AS dimension, coalesce(role, third) AS key, count(*) AS n, avg(a1) AS acc_at_1, avg(a3) AS acc_at_3, avg(a5) AS acc_at_5, avg(rr) AS mrr FROM h GROUP BY GROUPING SETS ((role), (third), ())"""


@query(_COMPLETED_SQL)
def evaluated_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-02, PRJ-08, PRJ-10, AGG-11, AGG-12, DED-10, SRT-04: a model's scored completions, the first five distinct ones, filled up, and their metrics in all and by groups."""
    rows = _read(spark, sf_dir, "conversations").select("text", "role", (F.col("turn") % 3).cast("string").alias("third"))
    gold = F.get(F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " "), lambda w: w != ""), F.lit(2))
    done = metrics.predicted(models.completed(rows.withColumn("gold", gold), "text", _longest_first), "completions", 5)
    return metrics.ranking_breakdowns(done, "predictions", "gold", "role", "third")


_WEIGHTS_SQL = f"""WITH w AS (SELECT quality, unnest(list_filter(string_split({_FOLD}, ' '), lambda x: x <> '')) AS word FROM documents JOIN labels USING (doc_id)),
c AS (SELECT word, count(*) FILTER (WHERE quality = 0) c0, count(*) FILTER (WHERE quality = 1) c1 FROM w GROUP BY word), t AS (SELECT sum(c0) n0, sum(c1) n1, count(*) v FROM c),
k AS (SELECT word, ln((c1 + 1) / (n1 + v)) - ln((c0 + 1) / (n0 + v)) AS weight FROM c, t WHERE length(word) >= 4)
SELECT word, weight, (row_number() OVER (ORDER BY round(weight, 9) DESC, word))::INTEGER AS place FROM k QUALIFY place <= 20 UNION ALL SELECT word, weight, (-row_number() OVER (ORDER BY round(weight, 9), word))::INTEGER AS place FROM k QUALIFY place >= -20"""


@query(_WEIGHTS_SQL)
def top_model_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-17: the words that weigh most, on either side, in a linear model of quality fitted on all labelled documents; of words with four letters or more."""
    words = _folded(spark, sf_dir).select("doc_id", F.filter(F.split("text", " "), lambda w: w != "").alias("words"))
    rows = words.join(_read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    weighed = models.word_weights(rows).filter(F.length("word") >= 4).withColumn("weight", F.round("weight", 9))
    return models.top_words(weighed, None, 20)


# --- Anchors

_DOT = "list_inner_product(e.embedding::DOUBLE[], a.embedding::DOUBLE[])"


@query(f"WITH n AS (SELECT e.label, e.vec_id, arg_max(a.vec_id, ({_DOT}, -a.vec_id)) AS anchor, max({_DOT}) AS similarity FROM embeddings e JOIN embeddings a ON e.vec_id % 2 = 1 AND a.vec_id % 2 = 0 GROUP BY ALL) SELECT label AS post, arg_max(vec_id, (similarity, -vec_id)) AS vec_id, arg_max(anchor, (similarity, -vec_id)) AS anchor, max(similarity) AS similarity FROM n WHERE similarity >= 0.2 GROUP BY label")
def best_of_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEP-14, VEC-02, WIN-10: of each post's sentences the one nearest to any anchor. Half of the embeddings plays anchors mined from the corpus, so both sides grow."""
    rows = _read(spark, sf_dir, "embeddings")
    return vector.post_best(rows.filter("vec_id % 2 = 1").withColumnRenamed("label", "post"), rows.filter("vec_id % 2 = 0"), "vec_id", "embedding", "vec_id", "post", 0.2)


# --- Streams

#: Files of a batch that takes all that are there.
EVERY = 1 << 30


def _landing_events(spark: SparkSession, sf_dir: str, slices: int = 4) -> Iterator[tuple[str, str]]:
    """(folder, schema) of events, each time another slice of them is there; slices follow each other in time. All tasks write a slice."""
    events, folder = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), _folder(spark, "events")
    low, high = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    step = (high - low) // slices + 1
    for i in range(slices):
        at = F.unix_micros("ts")
        events.filter((at >= low + i * step) & (at < low + (i + 1) * step)).write.mode("append").parquet(f"{folder}/in")
        yield folder, _ddl(events)


@contextmanager
def _store(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query("SELECT user_id, event_type, ts FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events) WHERE before IS NULL OR ts - before > INTERVAL 36 HOUR")
def stream_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01: rows of a stream whose key hasn't been seen for 36 hours; timers clear the state of keys that have been away.

    Four slices, a batch each: the stream is run when a slice has landed, and goes on from its checkpoint.
    """
    with _store(spark):
        for folder, schema in _landing_events(spark, sf_dir):
            stream = crawl.file_stream(spark, f"{folder}/in", schema, files=EVERY).select("user_id", "event_type", "ts")
            fresh = state.first_seen_expiring(stream, ["user_id", "event_type"], "ts", 36 * 3600, "1 hour")
            fresh.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kind = _read(spark, sf_dir, "events").schema["ts"].dataType
    return spark.read.parquet(f"{folder}/out").select("user_id", "event_type", F.col("ts").cast(kind).alias("ts"))


@query("SELECT CASE WHEN value < 10 THEN 'low' WHEN event_type = 'click' THEN 'click' ELSE 'passed' END AS reason, count(*) AS n FROM events GROUP BY 1")
def stream_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06: what each batch of a stream rejects is observed while it writes, and a listener adds up the batches' counts. Four batches, or more by a rest."""
    folder, schema = list(_landing_events(spark, sf_dir))[-1]
    files = len(spark.read.schema(schema).parquet(f"{folder}/in").inputFiles())
    rules = [("low", F.col("value") < 10), ("click", F.col("event_type") == "click")]
    deltas = state.run_reporting(spark, crawl.file_stream(spark, f"{folder}/in", schema, files=max(1, files // 4)), rules, f"{folder}/out", f"{folder}/checkpoint")
    totals = deltas.totals()
    written = spark.read.parquet(f"{folder}/out").count()
    if written != totals["passed"] or sum(totals.values()) != 2 * totals["scanned"]:
        raise RuntimeError("the counts of the batches aren't those of the rows written")
    return spark.createDataFrame([(k, n) for k, n in totals.items() if k != "scanned" and n], "reason string, n bigint")
