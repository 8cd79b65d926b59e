"""Queries of file formats, writers and the functions that earlier queries don't run: tables are written in a format, and read back by its reader. See ``catalog``."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, lexicon, metrics, mining, models, patterns, sampling, vector
from ..scratch import scratch
from ..sources import readers, sinks
from .catalog import _FOLD, _MATCH_SQL, FRAMES, NOUNS, SEEDS, _customers, _folded, _in, _lexicon, _read, query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _to_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.options(header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def _each(df: DataFrame, key: str, path: str) -> str:
    """Text files with a line each, one for each row of df (value, key)."""
    df.repartition(key).write.partitionBy(key).text(path)
    return path


# --- Readers of corpora


@query("""SELECT 'laroseda_' || CASE item_id % 2 WHEN 0 THEN 'positive' ELSE 'negative' END || '_' || item_id AS id, CASE WHEN item_id % 3 = 0 THEN text ELSE 'T' || item_id || chr(10) || text END AS text, NULL AS split, CASE item_id % 2 WHEN 0 THEN 'positive' ELSE 'negative' END || '/' || item_id % 5 AS labels FROM benchmark
UNION ALL SELECT 'poprero_train_' || item_id, text, 'train', 'l' || item_id % 4 FROM benchmark
UNION ALL SELECT 'red_v1_validation_' || (row_number() OVER (ORDER BY item_id) - 1), text, 'validation', 'e' || item_id % 7 FROM benchmark
UNION ALL SELECT 'red_v2_test_' || item_id, text, 'test', array_to_string(list_filter([CASE WHEN item_id % 2 = 1 THEN 'Tristețe' END, CASE WHEN item_id % 3 = 1 THEN 'Surpriză' END, CASE WHEN item_id % 5 = 1 THEN 'Bucurie' END], lambda x: x IS NOT NULL), ',') FROM benchmark
UNION ALL SELECT 'ro_sent_train_' || item_id, text, 'train', CASE WHEN item_id % 3 = 0 THEN '' ELSE (item_id % 2)::VARCHAR END FROM benchmark
UNION ALL SELECT 'reddit_roap_' || (row_number() OVER (ORDER BY item_id) - 1), text, NULL, 'RO' || item_id % 2 || '/' || coalesce(CASE WHEN item_id % 4 = 0 THEN 's' END, '') FROM benchmark""")
def small_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03 to SRC-08, SRC-25, DEP-03, PRJ-01: six formats of labelled corpora, each written from benchmark and read by its own reader."""
    rows, folder = _read(spark, sf_dir, "benchmark"), _folder(spark, "small")
    i = F.col("item_id")
    kind = F.when(i % 2 == 0, "positive").otherwise("negative")
    review = F.struct(i.cast("string").alias("index"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("T"), i)).alias("title"), F.col("text").alias("content"), (i % 5).alias("starRating"))
    _each(rows.select(kind.alias("kind"), (i % 8).alias("part"), review.alias("r")).groupBy("kind", "part").agg(F.to_json(F.struct(F.collect_list("r").alias("reviews"))).alias("value")).select(F.concat("kind", F.lit("-"), "part").alias("key"), "value"), "key", f"{folder}/reviews")
    reviewed = [readers.reviews(spark, {k: f"{folder}/reviews/key={k}-*"}) for k in ("positive", "negative")]
    stars = [r.withColumn("labels", F.concat_ws("/", F.col("original_labels")["label"], F.col("original_labels")["stars"])) for r in reviewed]
    news = readers.news(spark, {"train": _to_csv(rows.select(i.cast("string").alias("index"), F.col("text").alias("full_text"), F.concat(F.lit("l"), i % 4).alias("label")), f"{folder}/news")}).withColumn("labels", F.col("original_labels")["label"])
    ordered = readers.in_order(rows, "item_id")
    tweets = readers.tweets(spark, {"val": _to_csv(ordered.select(F.col("text").alias("Tweet"), F.concat(F.lit("e"), i % 7).alias("Emotion")), f"{folder}/tweets")}, across=True).withColumn("labels", F.col("original_labels")["emotion"])
    bits = F.array(*[(i % m == 1).cast("int") if m else F.lit(0) for m in (2, 3, 0, 0, 0, 0, 5)])
    tagged = rows.select((i % 8).alias("part"), F.struct("text", i.cast("string").alias("text_id"), bits.alias("agreed_labels")).alias("r")).groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value"))
    many = readers.multilabel_tweets(spark, {"test": _each(tagged, "part", f"{folder}/many")}).withColumn("labels", F.col("original_labels")["emotions"])
    felt = readers.sentiment(spark, {"train": _to_csv(rows.select(i.cast("string").alias("index"), "text", F.when(i % 3 == 0, "none").otherwise((i % 2).cast("string")).alias("label")), f"{folder}/felt")}).withColumn("labels", F.coalesce(F.col("original_labels")["label"], F.lit("")))
    none = F.lit(None).cast("string")
    ordered.select(F.col("text").alias("TEXT"), F.concat(F.lit("RO"), i % 2).alias("SUBDIALECT"), F.when(i % 4 == 0, "s").alias("STATUS"), none.alias("LABELS"), none.alias("PERSONAL INCLINATION")).write.parquet(f"{folder}/forum")
    forum = readers.forum(spark, f"{folder}/forum", across=True).withColumn("labels", F.concat(F.col("original_labels")["subdialect"], F.lit("/"), F.coalesce(F.col("original_labels")["status"], F.lit(""))))
    out = None
    for part in (*stars, news, tweets, many, felt, forum):
        part = part.select("id", "text", "split", "labels")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT 'lines' AS what, count(*) AS n FROM documents UNION ALL SELECT 'blank', count(*) FILTER (WHERE doc_id % 7 = 0) FROM documents UNION ALL SELECT 'broken', count(*) FILTER (WHERE doc_id % 7 = 1) FROM documents
UNION ALL SELECT 'kept', count(*) FILTER (WHERE doc_id % 7 > 1 AND length(trim(text, ' ' || chr(10))) > 0) FROM documents UNION ALL SELECT 'first', 25 UNION ALL SELECT 'ids', count(*) FILTER (WHERE doc_id % 7 > 1) FROM documents""")
def tolerant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14, SRC-28, SRC-29, PRJ-02, DEP-16, SNK-06: lines written as they are, some blank or broken; counted, read without those, numbered within their files, and the first 25."""
    path = f"{_folder(spark, 'raw')}/docs.jsonl"
    i = F.col("doc_id")
    line = F.when(i % 7 == 0, "").when(i % 7 == 1, F.concat(F.lit('{"text": "'), i)).otherwise(F.to_json(F.struct("text")))
    sinks.raw_lines(_read(spark, sf_dir, "documents").select(line.alias("value")), path)
    n = readers.broken_lines(spark, path)
    rows = readers.jsonl(spark, path)
    count = lambda df, what, c=F.count(F.lit(1)): df.agg(c.alias("n")).select(F.lit(what).alias("what"), "n")
    out = n.select(F.explode(F.create_map(F.lit("lines"), "n_lines", F.lit("blank"), "n_blank", F.lit("broken"), "n_broken")).alias("what", "n"))
    return out.unionByName(count(rows, "kept")).unionByName(count(readers.jsonl(spark, path, most=25), "first")).unionByName(count(rows, "ids", F.count_distinct(F.concat("source", "id"))))


@query("SELECT 'fulg_' || CASE WHEN doc_id % 3 = 0 THEN substr(md5(text), 1, 12) ELSE ((row_number() OVER (ORDER BY doc_id)) - 1)::VARCHAR END AS id, lang AS source_domain, n_chars AS n FROM documents QUALIFY n_chars >= 300")
def crawl_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, SRC-09: a landed crawl; records without digest are named by their place among all records, also those that are too short."""
    docs = readers.in_order(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    path = _folder(spark, "crawl")
    digest = F.when(F.col("doc_id") % 3 == 0, F.md5(F.col("text").cast("binary")))
    docs.select(F.col("text").alias("raw_content"), F.lit("u").alias("url"), F.col("lang").alias("source_domain"), F.length("text").alias("length"), digest.alias("digest")).write.json(path)
    return readers.crawl_files(spark, path, shortest=300).select("id", "source_domain", F.col("full_text_length").alias("n"))


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 1200 THEN text WHEN strpos(text, s) > 0 THEN text[greatest(strpos(text, s) - 500, 1) : strpos(text, s) + length(s) + 499] ELSE text[1:1200] END) AS context FROM (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 'no such part' ELSE text[length(text) // 2 : length(text) // 2 + 30] END AS s FROM documents)")
def prompt_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEP-11: what of a text a validating model sees: 500 code points on either side of the match if it is longer than 1200."""
    half = F.floor(F.length("text") / 2).cast("int")
    sentence = F.when(F.col("doc_id") % 4 == 0, F.lit("no such part")).otherwise(F.substring(F.col("text"), half, F.lit(31)))
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(T.prompt_context(F.col("text"), sentence).cast("binary")).alias("context"))


# --- Readers of lexicons and results


@query("""SELECT 'form' AS kind, lower(p_brand) || p_partkey AS a, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) || p_partkey ELSE p_type END AS b, 'A' || p_size AS c FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT 'synset', p_partkey::VARCHAR, (p_partkey + k * 1000)::VARCHAR, (p_size + k)::DOUBLE::VARCHAR FROM part, range(1, 3) r(k) WHERE p_partkey % 2 = 0 OR k = 1
UNION ALL SELECT 'affect', p_name || p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'adjective' ELSE 'noun' END, p_partkey::VARCHAR FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 7 <> 0
UNION ALL SELECT 'sniffed', p_brand || p_partkey, p_size::VARCHAR, (p_size % 2 = 0)::VARCHAR FROM part
UNION ALL SELECT 'tree', n_name, r_name, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'categ', n_nationkey::VARCHAR, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR END, CASE WHEN n_nationkey % 2 = 1 THEN n_name END FROM nation""")
def lexical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15 to SRC-19: morphology, synset maps, taxonomies and lexicons in their formats, written from part, nation and region."""
    part, folder = _read(spark, sf_dir, "part"), _folder(spark, "lexical")
    k = F.col("p_partkey")
    text = lambda df, name: df.write.text(f"{folder}/{name}") or f"{folder}/{name}"
    as_ = lambda df, kind, *c: df.select(F.lit(kind).alias("kind"), *[x.cast("string").alias(n) for n, x in zip("abc", c, strict=True)])
    form = F.concat(F.lower("p_brand"), k)
    lines = part.select(F.when(k % 5 == 0, F.concat_ws("\t", form, "p_type")).otherwise(F.concat_ws("\t", form, F.when(k % 3 == 0, "=").otherwise(F.col("p_type")), F.concat(F.lit("A"), "p_size"))).alias("value"))
    out = as_(readers.morphology(spark, text(lines, "forms")), "form", F.col("form"), F.col("lemma"), F.col("msd"))
    pair = lambda n: F.concat_ws(" ", k + n * 1000, F.col("p_size") + n)
    lines = part.select(F.concat_ws("  ", k, pair(1), F.when(k % 2 == 0, pair(2))).alias("value"))
    out = out.unionByName(as_(readers.synset_map(spark, text(lines, "synsets"), "n"), "synset", F.col("off16"), F.col("off30"), F.col("conf")))
    lines = part.select(F.concat("p_name", k).alias("word"), F.get(F.array(F.lit("Adjective"), F.lit("Noun"), F.lit("Verb")), (k % 3).cast("int")).alias("part_of_speech"), F.when(k % 7 == 0, "none").otherwise(F.concat(F.lit("ENG30-"), F.lpad(k.cast("string"), 8, "0"), F.lit("-a"))).alias("wn_synset_id"))
    out = out.unionByName(as_(readers.affect_lexicon(spark, _to_csv(lines, f"{folder}/affect", ";")), "affect", F.col("word"), F.col("pos"), F.col("offset")))
    lines = part.select(F.concat("p_brand", k).alias("Cuvant"), F.col("p_size").alias("Size"), F.when(F.col("p_size") % 2 == 0, "Da").otherwise("nu").alias("even"))
    sniffed = readers.sniffed_csv(spark, _to_csv(lines, f"{folder}/sniffed", ";"), {"word": ["word", "cuvant"], "size": ["size"], "even": ["even"]})
    out = out.unionByName(as_(sniffed, "sniffed", F.col("word"), F.col("size"), readers.truthy(F.col("even"))))
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    rooted = lambda df, tag, name: _each(df.groupBy("key").agg(F.concat(F.lit("<r>"), F.array_join(F.collect_list(tag), ""), F.lit("</r>")).alias("value")), "key", f"{folder}/{name}")
    tag = F.concat(F.lit('<categ name="'), "n_name", F.lit('" isa="'), "r_name", F.lit('"/>'))
    tree = nation.join(region, nation.n_regionkey == region.r_regionkey).withColumn("key", F.col("n_regionkey"))
    out = out.unionByName(as_(readers.taxonomy(spark, rooted(tree, tag, "tree")), "tree", F.col("name"), F.col("parent"), F.lit(None)))
    own = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('noun-id="'), "n_regionkey", F.lit('"'))).otherwise(F.concat(F.lit('categ="'), "n_name", F.lit('"')))
    tag = F.concat(F.lit('<adj-syn id="'), "n_nationkey", F.lit('" '), own, F.lit("/>"))
    return out.unionByName(as_(readers.affect_synsets(spark, rooted(nation.withColumn("key", F.col("n_regionkey")), tag, "synset-tags"), "adj-syn"), "categ", F.col("id"), F.col("noun_id"), F.col("category")))


@query("""SELECT 'score' AS kind, user_id::VARCHAR AS a, arg_max(event_id % 4, event_id)::VARCHAR AS b FROM events GROUP BY user_id
UNION ALL SELECT 'labels', item_id::VARCHAR, 'a' || item_id || ',b/2' FROM benchmark
UNION ALL SELECT 'translated', item_id::VARCHAR, CASE WHEN item_id % 3 = 0 THEN text ELSE 'en ' || item_id END FROM benchmark
UNION ALL SELECT 'lexicon', lower(p_brand) || '-' || p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'adjective:joy' ELSE 'noun:fear' END FROM part""")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20 to SRC-23, LEX-05, LEX-06, MAP-01: annotators' CSVs, labelled and translated rows, and lexicons, written and read back."""
    folder = _folder(spark, "results")
    as_ = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), a.cast("string").alias("a"), b.cast("string").alias("b"))
    e, names = F.col("event_id"), ("not_affect", "unlike_affect", "like_affect", "is_affect")
    events = readers.in_order(_read(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    ticked = [F.when((e % 2 == 0) & (e % 4 == i), "true").otherwise("false").alias(f"Answer.affect.{n}") for i, n in enumerate(names)]
    said = F.when(e % 2 == 1, F.get(F.array(*map(F.lit, names)), (e % 4).cast("int"))).alias("Answer.affect")
    scores = readers.annotations(spark, _to_csv(events.select(F.col("user_id").alias("Input.id"), *ticked, said), f"{folder}/answers"))
    out = as_(scores, "score", F.col("id"), F.col("score"))
    bench = _read(spark, sf_dir, "benchmark")
    literal = F.concat(F.lit("['a"), "item_id", F.lit("', \"b\"]"))
    labelled = readers.labelled_csv(spark, _to_csv(bench.select(F.concat(F.lit(""), F.col("item_id").cast("string")).alias("id"), F.concat(F.lit("[MASK] [MASK] "), "text").alias("input"), literal.alias("labels")), f"{folder}/labelled"), "en")
    out = out.unionByName(as_(labelled, "labels", F.col("id"), F.concat(F.array_join("labels", ","), F.lit("/"), "n_masks")))
    twins = bench.withColumn("text_en", F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("en "), "item_id")))
    out = out.unionByName(as_(readers.translated(twins, ["text", "other"]), "translated", F.col("item_id"), F.col("text")))
    part, k = _read(spark, sf_dir, "part"), F.col("p_partkey")
    word = F.concat_ws("-", F.lower("p_brand"), k)
    maps = part.groupBy(F.expr("p_partkey div 10000").alias("part")).agg(  # a file for so many words
        F.to_json(F.struct(
            F.map_from_entries(F.collect_list(F.when(k % 2 == 0, F.struct(word, F.lit("joy"))))).alias("adjectives"), F.map_from_entries(F.collect_list(F.when(k % 2 == 1, F.struct(word, F.array(F.lit("fear"), F.lit("x")))))).alias("nouns"), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>").alias("adverbs"),
        )).alias("value")
    )
    lex = readers.lexicon_json(spark, _each(maps, "part", f"{folder}/lexicon"))
    return out.unionByName(as_(lex, "lexicon", F.col("word"), F.concat_ws(":", "pos", "category")))


@query("SELECT 'pool_' || lower(lang) || '_' || (row_number() OVER (ORDER BY doc_id) - 1) AS id, CASE WHEN strpos(s, 'the') > 0 THEN regexp_replace(s, '[^ ]*the[^ ]*', '[MASK]') END AS input, CASE WHEN strpos(s, 'the') > 0 THEN regexp_extract(s, '[^ ]*the[^ ]*') END AS label FROM (SELECT doc_id, lang, regexp_replace(lower(text), '[^a-z]+', ' ', 'g') s FROM documents)")
def masked_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-30, TXT-32, PRJ-03: a pool of sentences whose token with the word is masked; the row's number in the file makes the id."""
    docs = readers.in_order(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    rows = docs.withColumn("text", F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    path = _to_csv(rows.select(F.col("text").alias("sentence"), F.lit("the").alias("emotion_word"), F.concat_ws("-", F.upper("lang"), F.lit("x")).alias("source")), _folder(spark, "pool"))
    return readers.masked_pool(spark, path, "pool", across=True).select("id", "input", F.get("labels", F.lit(0)).alias("label"))


@query("SELECT user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'cached ' ELSE 'fetched ' END || user_id AS text FROM (SELECT DISTINCT user_id FROM events)")
def cached_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-27: what a cache holds is taken from it, the rest is fetched once for each key."""
    wanted = _read(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    cache = _read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("cached "), "c_custkey").alias("text"))
    return readers.with_cache(wanted, cache, "id", lambda keys: keys.withColumn("text", F.concat(F.lit("fetched "), "id")))


# --- Writers


@query("SELECT 'appended' AS what, 2 * count(*) AS n, 2 * sum(item_id) AS total FROM benchmark UNION ALL SELECT 'refused', count(*), sum(item_id) FROM benchmark UNION ALL SELECT 'all', count(*), sum(item_id) FROM benchmark UNION ALL SELECT 'kept', count(*), sum(item_id) FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT 'presented', count(*), sum(item_id) FROM benchmark")
def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02, SNK-04, SNK-05, SNK-11, SNK-12: appended on a resume, refused where something lies, written to two places, and in the form that is shown."""
    rows, folder = _read(spark, sf_dir, "benchmark"), _folder(spark, "written")
    sinks.jsonl(rows, f"{folder}/a")
    sinks.jsonl(rows, f"{folder}/a", resume=True)
    sinks.jsonl_once(rows, f"{folder}/b")
    try:
        sinks.jsonl_once(rows.limit(1), f"{folder}/b")
    except Exception as error:
        if "PATH_ALREADY_EXISTS" not in str(error):
            raise
    sinks.fan_out(rows, f"{folder}/c", f"{folder}/d", F.col("item_id") % 3 == 0)
    sinks.presentation_csv(rows.select(F.concat(F.lit("x_"), "item_id").alias("id"), F.col("text").alias("input"), F.array(F.lit("w")).alias("labels")), f"{folder}/e")
    shown = spark.read.options(header=True, escape='"', multiLine=True).csv(f"{folder}/e").filter("labels = \"['w']\"").select(F.substring_index("id", "_", -1).cast("bigint").alias("item_id"))
    parts = {"appended": spark.read.json(f"{folder}/a"), "refused": spark.read.json(f"{folder}/b"), "all": spark.read.parquet(f"{folder}/c"), "kept": spark.read.parquet(f"{folder}/d"), "presented": shown}
    out = None
    for what, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum("item_id").cast("bigint").alias("total")).select(F.lit(what).alias("what"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


_MARKED = "<span style=\"background-color:#2dfe5f\">"


@query(f"""WITH t AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS x FROM benchmark), s AS (SELECT *, x[1:40] AS m FROM t), f AS (SELECT *, strpos(lower(x), 'the') p, strpos(lower(m), 'the') q FROM s)
SELECT item_id::VARCHAR AS id, '<strong>' || CASE WHEN q > 0 THEN m[1:q - 1] || '{_MARKED}' || m[q : q + 2] || '</span>' || m[q + 3 :] ELSE m END || '</strong><br>' AS short_context,
CASE WHEN item_id % 2 = 0 THEN '<em>V' || item_id || '</em><br><br>' ELSE '' END || CASE WHEN p > 0 THEN x[1:p - 1] || '{_MARKED}' || x[p : p + 2] || '</span>' || x[p + 3 :] ELSE x END || '<br>' AS full_context, 'the' AS emo_term, 'show' AS show_inst FROM f""")
def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07, TXT-21, TXT-17, TXT-18: the rows that annotators see, as a CSV that is read back."""
    x = F.regexp_replace("text", "[^ -~]", "")
    rows = _read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), x.alias("text"), F.left(x, F.lit(40)).alias("matched_sentence"), F.lit("the").alias("seed_word"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("V"), "item_id")).otherwise("").alias("video_title"))
    path = _folder(spark, "annotations")
    sinks.annotation_csv(rows, path)
    return spark.read.options(header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


@query("SELECT '| ' || lang || ' | ' || count(*) || ' | ' || printf('%.3f', avg(n_chars)) || ' |' AS line FROM documents GROUP BY lang UNION ALL SELECT '| lang | n | mean |' UNION ALL SELECT '| --- | --- | --- |'")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10, TXT-40, SRT-05: a table of results, ordered by a given list, as Markdown."""
    table = _read(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"))
    return spark.createDataFrame([(x,) for x in sinks.markdown(corpus.ordered(table, ("lang", ["fr", "de"]))).split("\n")], "line string")


# --- Text


@query(r"""WITH c AS (SELECT doc_id, text, list_concat([0], list_transform(generate_series(1, len(regexp_extract_all(text, '[.!?]+(\s+|$)'))), lambda i: list_sum(list_transform(regexp_split_to_array(text, '[.!?]+(\s+|$)')[1:i], lambda p: length(p))) + list_sum(list_transform(regexp_extract_all(text, '[.!?]+(\s+|$)')[1:i], lambda p: length(p)))::BIGINT)) AS cuts FROM benchmark_texts)
SELECT doc_id, start, stop, body FROM (SELECT doc_id, unnest(cuts) AS start, unnest(list_append(cuts[2:], length(text))) AS stop, unnest(list_transform(generate_series(1, len(cuts)), lambda i: regexp_replace(text[cuts[i] + 1 : coalesce(cuts[i + 1], length(text))], '^\s+|\s+$', '', 'g'))) AS body FROM c) WHERE length(body) > 10""".replace("benchmark_texts", "(SELECT item_id AS doc_id, text FROM benchmark)"))
def cut_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-03: sentences with their places."""
    rows = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.explode(T.sentences(F.col("text"))).alias("s"))
    return rows.select("doc_id", F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("stop"), F.col("s.text").alias("body"))


@query(r"""SELECT item_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 5) AS pieces, translate(text || 'şţŞŢ', 'şţŞŢ', 'șțȘȚ') AS commas, md5(item_id || '|' || text) AS key,
CASE WHEN length(text) <= 60 THEN text WHEN strpos(text, 'and') > 0 THEN text[greatest(strpos(text, 'and') - 20, 1) : strpos(text, 'and') + 22] ELSE text[1:60] END AS near FROM benchmark""")
def text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-38, TXT-37, TXT-18, DED-04: the archived sentence cut, comma letters, keys of parts, and the window around a part."""
    x = F.col("text")
    return _read(spark, sf_dir, "benchmark").select(
        "item_id", T.sentences_at_blanks(x).alias("pieces"), T.comma_letters(F.concat(x, F.lit("şţŞŢ"))).alias("commas"), T.key_of(F.col("item_id").cast("string"), x).alias("key"), T.window_around(x, F.lit("and"), 60, 20).alias("near")
    )


@query("""SELECT p_partkey, CASE WHEN w LIKE '%it' THEN w[1:-3] || 'ită' WHEN w LIKE '%at' THEN w[1:-3] || 'ată' WHEN w LIKE '%ut' THEN w[1:-3] || 'ută' WHEN w LIKE '%os' THEN w[1:-3] || 'oasă' WHEN w LIKE '%nic' THEN w[1:-3] || 'ică' WHEN w LIKE '%t' THEN w[1:-2] || 'tă' END AS feminine,
length(m) >= 6 AND m[6] = 's' AND m LIKE '%n' AND m[7] NOT IN ('o', 'v') AS adjective, length(m) >= 5 AND m[5] = 's' AND m LIKE '%n' AS noun FROM (SELECT p_partkey, lower(replace(p_type, ' ', '')) || ['it', 'at', 'ut', 'os', 'nic', 't', 'x'][p_partkey % 7 + 1] AS w, lower(replace(p_name, ' ', ''))[1 : p_partkey % 9] || ['sn', 'son', 'svn', 'ssn', 'n'][p_partkey % 5 + 1] AS m FROM part)""")
def word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-08, FLT-13, FLT-14: regular feminines, and which tags make a usable adjective or noun form."""
    k = F.col("p_partkey")
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    w = F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit(""))), pick(("it", "at", "ut", "os", "nic", "t", "x")))
    m = F.concat(F.left(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))), (k % 9).cast("int")), pick(("sn", "son", "svn", "ssn", "n")))
    return _read(spark, sf_dir, "part").select("p_partkey", T.feminine_form(w).alias("feminine"), lexicon.adjective_form(m).alias("adjective"), lexicon.noun_form(m).alias("noun"))


@query(r"""SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(x, '\s*>>\s*|\s*#[^#]*#\s*', chr(1), 'g'), '([a-z,?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '') AS parts FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '>> ' ELSE '#muzică# ' END || regexp_replace(text, '[^ -~\n]', '', 'g') AS x FROM conversations)""")
def caption_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-12: captions cut at speakers, tags and capitals."""
    x = F.concat(F.when(F.col("turn") % 3 == 0, ">> ").otherwise("#muzică# "), F.regexp_replace("text", "[^ -~\n]", ""))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.caption_sentences(x).alias("parts"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '), lambda x: x <> '') ws FROM conversations)
SELECT conv_id, turn, CASE WHEN len(list_filter(lw, lambda x: contains(x, 'the') AND contains(x, 'n'))) > 0 THEN list_position(lw, list_filter(lw, lambda x: contains(x, 'the') AND contains(x, 'n'))[1]) WHEN len(list_filter(lw, lambda x: contains(x, 'the'))) > 0 THEN list_position(lw, list_filter(lw, lambda x: contains(x, 'the'))[1]) ELSE len(lw) // 2 + 1 END AS place FROM (SELECT *, list_transform(ws, lambda x: lower(x)) lw FROM w)""")
def match_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-15: the part that holds the match: seed and trigger, else the seed, else the middle one."""
    ws = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " "), lambda w: w != "")
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.match_position(ws, F.lit("the"), ("n",)).cast("bigint").alias("place"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'word' || event_id WHEN 1 THEN 'tired' WHEN 2 THEN 'alone' ELSE 'stare' END AS word FROM events""")
def felt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-28: the state that a translated sentence names, else the first word of the translated word, else the word itself."""
    e = F.col("event_id")
    said = F.when(e % 4 == 0, F.concat(F.lit("So I feel Word"), e, F.lit(" now"))).when(e % 4 == 1, "I'm feeling Tired.").otherwise("Nothing.")
    return _read(spark, sf_dir, "events").select("event_id", T.felt_word(said, F.when(e % 4 == 2, " Alone again").otherwise(""), F.lit("stare")).alias("word"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN true ELSE event_id % 2 = 0 END AS is_affective, CASE event_id % 5 WHEN 4 THEN 0.0 WHEN 3 THEN 0.5 ELSE (event_id % 10) / 10 END::DOUBLE AS confidence, CASE event_id % 5 WHEN 4 THEN 'failed_to_parse: no ' || event_id WHEN 3 THEN 'parse_error' ELSE 'r' || event_id END AS reasoning FROM events""")
def reply_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-31, DEP-11: verdicts of a model's replies: plain, fenced, within words, broken, or none."""
    e = F.col("event_id")
    body = F.to_json(F.struct((e % 2 == 0).alias("is_affective"), ((e % 10) / 10).alias("confidence"), F.concat(F.lit("r"), e).alias("reasoning")))
    said = F.when(e % 5 == 0, body).when(e % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(e % 5 == 2, F.concat(F.lit("Well: "), body, F.lit(" so."))).when(e % 5 == 3, '{"is_affective": true, ').otherwise(F.concat(F.lit("no "), e))
    return _read(spark, sf_dir, "events").select("event_id", T.affect_verdict(said).alias("v")).select("event_id", "v.*")


#: Bytes of documents, as their file has them, of a task that cuts windows: a second or more of work each, however large a file's row groups are.
WINDOW_BYTES = readers.SHORT_BYTES


@query(f"SELECT doc_id, array_to_string(ws[i - 2 : i - 1], ' ') AS before, ws[i] AS matched, array_to_string(ws[i + 1 : i + 2], ' ') AS after FROM (SELECT doc_id, ws, list_position(ws, list_filter(ws, lambda w: w LIKE 'and%')[1]) i FROM (SELECT doc_id, list_transform(list_filter(string_split({_FOLD}, ' '), lambda w: length(w) > 2 AND w NOT LIKE '%and%' OR w LIKE 'and%'), lambda w: w || ' sentence.') ws FROM documents)) WHERE i > 0")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-04: two sentences on either side of a match's. Each word of a document makes a sentence here."""
    ws = F.filter(F.split("text", " "), lambda w: ((F.length(w) > 2) & ~F.contains(w, F.lit("and"))) | F.startswith(w, F.lit("and")))
    rows = _folded(spark, sf_dir, WINDOW_BYTES).select("doc_id", F.array_join(F.transform(ws, lambda w: F.concat(w, F.lit(" sentence."))), " ").alias("x"))
    at = (F.position(F.lit(" and"), F.concat(F.lit(" "), "x")) - 1).cast("int")
    return rows.withColumn("at", at).filter("at >= 0").select("doc_id", T.context_window(F.col("x"), F.col("at"), F.col("at") + 3, most=1_000_000).alias("w")).select("doc_id", "w.*")


@query(f"SELECT doc_id, regexp_matches({_FOLD}, '(^| )(that|with)( |$)') AS has_word, contains(lower(text), 'thing') AS has_trigger FROM documents")
def trigger_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18, FLT-03: whole trigger words between characters that aren't letters, and triggers anywhere."""
    rows = _folded(spark, sf_dir).join(_read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw")), "doc_id")
    return rows.select("doc_id", patterns.has_trigger_word(F.col("text"), ("that", "with")).alias("has_word"), patterns.has_trigger(F.col("raw"), ("thing",)).alias("has_trigger"))


# --- Lexicons, anchors, models


@query("SELECT lower(p_brand) AS word, CASE WHEN min(p_size) % 2 = 0 THEN 'noun' ELSE 'adjective' END AS pos, 'known' AS category FROM part WHERE p_brand < 'Brand#3' GROUP BY 1, p_brand UNION ALL SELECT lower(p_type), CASE WHEN max(p_size) % 3 = 0 THEN 'adjective' ELSE 'noun' END, min(p_brand) FROM part GROUP BY 1, p_type")
def enriched_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEX-01, JOIN-12: a seed with the words that were found, their part of speech guessed from their gender."""
    part = _read(spark, sf_dir, "part")
    seed = part.filter("p_brand < 'Brand#3'").groupBy(F.lower("p_brand").alias("word")).agg(F.when(F.min("p_size") % 2 == 0, "noun").otherwise("adjective").alias("pos"), F.lit("known").alias("category"))
    new = part.groupBy(F.lower("p_type").alias("word")).agg(F.lit(0.9).alias("confidence"), F.array(F.lit("distributional")).alias("methods"), F.array(F.min("p_brand")).alias("emotions"), F.when(F.max("p_size") % 3 == 0, "m").alias("gender"))
    again = seed.select("word", F.lit(0.5).alias("confidence"), F.array(F.lit("bootstrapping")).alias("methods"), F.array(F.lit("x")).alias("emotions"), F.lit("f").alias("gender"))
    return lexicon.enrich(seed, new.unionByName(again)).select("word", "pos", "category")


@query("SELECT emotion, count(DISTINCT word) AS n FROM (SELECT lower(p_brand) || ' ' || p_size AS word, p_type AS emotion FROM part UNION ALL SELECT lower(p_brand) || ' ' || p_size || 'a', p_type FROM part WHERE p_size % 2 = 0) GROUP BY emotion")
def paired_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEP-04, TXT-39: a lexicon of masculine and feminine pairs, flattened; how many words carry each emotion."""
    word = F.concat_ws(" ", F.lower("p_brand"), "p_size")
    pairs = _read(spark, sf_dir, "part").select(word.alias("masculine"), F.when(F.col("p_size") % 2 == 0, F.concat(word, F.lit("a"))).alias("feminine"), F.array("p_type").alias("emotions"))
    return lexicon.coverage(lexicon.from_pairs(pairs))


@query("SELECT word FROM (SELECT lower(p_brand) word, list(DISTINCT p_type) tags FROM part GROUP BY p_brand) WHERE list_has_any(tags, (SELECT list(t) FROM (SELECT min(p_type) t FROM part UNION SELECT max(p_type) FROM part)))")
def tagged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-19: words with any of the tags."""
    part = _read(spark, sf_dir, "part")
    low, high = part.agg(F.min("p_type"), F.max("p_type")).first()
    return lexicon.of_tags(part.groupBy(F.lower("p_brand").alias("word")).agg(F.collect_set("p_type").alias("tags")), [low, high]).select("word")


@query("SELECT DISTINCT n_name || ' ' || p_brand AS sentence FROM nation JOIN (SELECT DISTINCT p_brand, p_brand LIKE '%1' AS noun FROM part) ON (n_nationkey % 2 = 0) = noun")
def made_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-06, DED-11: templates with the words that suit them, as distinct sentences."""
    templates = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("phrase"), (F.col("n_nationkey") % 2 == 0).alias("noun_only"))
    words = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("word"), F.col("p_brand").endswith("1").alias("noun")).distinct()
    return vector.anchors_from(templates, words).select("sentence")


def _letters(texts: list[str]) -> np.ndarray:
    """A stand-in for an encoder: how often each letter occurs."""
    return np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], np.float32)


@query(f"SELECT doc_id, round(CASE WHEN s = 0 THEN 0 ELSE v[5] / sqrt(s) END, 4) AS e FROM (SELECT *, list_sum(list_transform(v, lambda n: n * n)) s FROM (SELECT doc_id, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length(x) - length(replace(x, c, '')))::DOUBLE) v FROM (SELECT doc_id, 'query: ' || {_FOLD} AS x FROM documents)))")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-01: unit vectors of texts by an injected encoder."""
    return vector.embedded(_folded(spark, sf_dir), "text", _letters).select("doc_id", F.round(F.get("embedding", F.lit(4)).cast("double"), 4).alias("e"))


@query("SELECT conv_id, turn, CASE WHEN length(text) % 5 < 4 THEN length(text) % 5 END AS llm_affect_score, 'stand-in' AS llm_model FROM conversations WHERE turn % 2 = 0")
def scored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-01: scores by an injected model, parsed from its replies, for the rows that aren't done."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return models.scored(rows, ["conv_id", "turn"], F.col("text"), lambda xs: [f"Score: {len(x) % 5}" for x in xs], "stand-in", rows.filter("turn % 2 = 1")).select("conv_id", "turn", "llm_affect_score", "llm_model")


@query("SELECT conv_id, array_to_string(p, ',') AS persons FROM (SELECT conv_id, list_transform(list(text ORDER BY turn), lambda t: length(t) % 3 + 1)::VARCHAR[] AS p FROM conversations GROUP BY conv_id)")
def tagged_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-04: the person of each part by an injected tagger."""
    turns = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("parts"))
    return models.persons(turns, "parts", lambda xs: [len(x) % 3 + 1 for x in xs]).select("conv_id", F.array_join("persons", ",").alias("persons"))


@query("SELECT role, count(*) AS n, avg((len(list_filter([w[1]], lambda o: o = w[1])) > 0)::INT) AS set_acc_at_1, avg(1) AS set_acc_at_3, avg(1) AS set_acc_at_5, avg(1.0::DOUBLE) AS coverage_at_1, avg(1.0::DOUBLE) AS coverage_at_3, avg(1.0::DOUBLE) AS coverage_at_5 FROM (SELECT role, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') w FROM conversations) WHERE len(w) > 0 GROUP BY role")
def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13: accuracy and coverage of label sets; here the only label is what the first output says."""
    ws = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda w: w != "")
    rows = _read(spark, sf_dir, "conversations").select("role", F.slice(ws, 1, 5).alias("outputs"), F.slice(ws, 1, 1).alias("labels")).filter(F.size("outputs") > 0)
    return metrics.set_scores(rows, "outputs", "labels", "role")


@query("SELECT item_id, array_to_string(list_concat(list_transform(range(greatest(0, n - 8), n), lambda i: i::VARCHAR), list_transform(range(greatest(0, 8 - n)), lambda i: '0')), ',') AS input_ids, list_sum(list_transform(range(greatest(0, n - 8), n), lambda i: (i >= n - 2)::INTEGER))::INTEGER AS learned FROM (SELECT item_id, 3 + item_id % 10 AS n FROM benchmark)")
def encoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-07: prompt and target as arrays, cut from the left, padded, with a loss on the target only."""
    n = (F.lit(3) + F.col("item_id") % 10).cast("int")
    made = models.training_arrays(F.sequence(F.lit(0), n - 3), F.sequence(n - 2, n - 1), 8)
    return _read(spark, sf_dir, "benchmark").select("item_id", made.alias("x")).select("item_id", F.array_join("x.input_ids", ",").alias("input_ids"), F.size(F.filter("x.labels", lambda v: v >= 0)).alias("learned"))


@query(f"SELECT q AS phrase FROM (SELECT unnest(list_transform([{_in(SEEDS[:3])}], lambda w: '\"the ' || w || '\"')) q UNION ALL SELECT unnest(list_transform([{_in(SEEDS[:3])}], lambda w: '\"of ' || w || '\"'))) WHERE (SELECT count(*) FROM benchmark WHERE contains(lower(text), replace(q, '\"', ''))) > 0")
def searched_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-15, PAT-18: the grid of search phrases, and which of them the texts hold."""
    grid = spark.createDataFrame([(q,) for q in patterns.query_grid(["the", "of"], list(SEEDS), 3)], "phrase string")
    texts = _read(spark, sf_dir, "benchmark").select(F.lower("text").alias("x"))
    hits = texts.select(F.explode(F.array(*[F.when(F.contains("x", F.lit(q.strip('"'))), q) for q in patterns.query_grid(["the", "of"], list(SEEDS), 3)])).alias("phrase")).filter("phrase IS NOT NULL")
    return sampling.head_sample(grid, 100, "phrase").join(hits.distinct(), "phrase", "left_semi")


# --- Words as written, forms, drivers of single functions

_APART = r"[^\p{L}\p{M}\p{Nd}_]"


@query(f"SELECT doc_id, regexp_extract(text, '(?i)(^|{_APART})(the)({_APART}|$)', 2) AS word FROM documents WHERE regexp_matches(text, '(?i)(^|{_APART})the({_APART}|$)')")
def written_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-06: the word of a match as it is written, found near the match's start by its normal form."""
    start = F.length(F.get(F.split("text", rf"(?i)(?U)(?<!\w)the(?!\w)", 2), F.lit(0)))
    rows = _read(spark, sf_dir, "documents").withColumn("start", start).filter(F.col("start") < F.length("text"))
    return rows.select("doc_id", T.original_word(F.col("text"), F.col("start"), F.lit("the")).alias("word"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_id % 2 = 0) AS had_speaker_change, count(*) AS had_leading_fragment, round_even(avg(CASE WHEN event_id % 2 = 0 THEN 33 ELSE 26 END + length(event_type)), 0) AS avg_chars_before, round_even(avg(11 + length(event_type)), 0) AS avg_chars_after, sum(11 + length(event_type))::BIGINT AS light FROM events")
def light_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-14, PRJ-04: captions as sentences, with what was found in them: of several speakers' parts the one with the seed, without tags and leading fragments."""
    said = F.concat(F.lit("Start "), "event_type", F.lit(" end"))
    x = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(">> Nothing here >> #m# "), said)).otherwise(F.concat(F.lit("so it goes. #m# "), said))
    out, counts = corpus.light_captions(_read(spark, sf_dir, "events").select(x.alias("text"), F.col("event_type").alias("seed_word")))
    return counts.join(F.broadcast(out.agg(F.sum(F.length("text_light")).alias("light"))))  # a row on either side


@query("SELECT item_id, 'name-' || item_id || 'b' AS model, replace(text, 'the', '<mask>') AS asked FROM benchmark")
def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-06: a model's short name, and its own mask in the place of the corpus'."""
    rows = _read(spark, sf_dir, "benchmark")
    return rows.select("item_id", models.short_name(F.concat(F.lit("owner/name-"), "item_id", F.lit("b"))).alias("model"), models.with_mask_of(F.col("text"), "<mask>", own="the").alias("asked"))


@query("SELECT DISTINCT lower(p_brand) AS word, true AS noun, 'e' || (p_brand LIKE '%1')::INT AS emotions FROM part UNION ALL SELECT DISTINCT lower(p_brand) || 'x', false, 'e' || (p_brand LIKE '%1')::INT FROM part")
def expanded_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-07, PAT-08, TXT-39, FLT-14: words with the forms that a morphology gives them; nouns count as nouns in their own form only."""
    words = _read(spark, sf_dir, "part").select(F.lower("p_brand").alias("word"), F.lit("noun").alias("pos"), F.array(F.concat(F.lit("e"), F.col("p_brand").endswith("1").cast("int"))).alias("emotions")).distinct()
    forms = words.select(F.concat("word", F.lit("x")).alias("form"), F.col("word").alias("lemma"), F.lit("Ncfssn").alias("msd")).unionByName(words.select(F.concat("word", F.lit("y")).alias("form"), F.col("word").alias("lemma"), F.lit("Ncfpsy").alias("msd")))
    return lexicon.expand(words, forms).select("word", "noun", F.array_join("emotions", ",").alias("emotions"))


@query("SELECT regexp_extract(url, '://([^/]+)', 1) AS domain, count(*) AS n, max(length(html))::INTEGER AS longest FROM (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY md5(html) ORDER BY page_id) = 1) GROUP BY 1")
def page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEP-06: pages distinct by the digest of their whole text, counted by domain."""
    pages = _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("domain"), F.length("html").alias("n_chars"), F.md5(F.col("html").cast("binary")).alias("key"))
    return corpus.first_by(pages, ["key"], ["page_id"]).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))


@query(f"SELECT CASE WHEN seed IN ({_in(NOUNS)}) THEN 0.9 WHEN pattern IN ('the_state', 'of_state') THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, count(*) AS n FROM ({_MATCH_SQL}) GROUP BY 1")
def match_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEP-12: confidence of matches: known words, else words of primary templates, else the others."""
    found = patterns.find_matches(_folded(spark, sf_dir), _lexicon(spark), templates=FRAMES, most=None, modifier="")
    return corpus.counts(found.select(mining.frame_confidence(F.col("seed").isin(*NOUNS), F.col("category")).cast("double").alias("confidence")), "confidence")


@query(f"SELECT doc_id, regexp_replace(x, '(^| )the( |$)', '\\1[MASK]\\2') AS masked FROM (SELECT doc_id, 'so ' || {_FOLD} AS x FROM documents) WHERE regexp_matches(x, '(^| )the( |$)')")
def translated_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-03, TXT-27: texts translated by an injected model, and the translated word masked in a second pass."""
    done = models.generated(_folded(spark, sf_dir), "text", lambda xs: [f"so {x}" for x in xs], "translated")
    return done.select("doc_id", T.mask_word(F.col("translated"), F.lit("the")).alias("masked")).filter("masked IS NOT NULL")


@query("SELECT c_custkey AS custkey, p AS pattern, w AS seed FROM customer, (VALUES ('ne_simtim_present', 'bine'), ('suntem_adj_present', 'calm')) t(p, w)")
def archived_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-16, DEP-01: the archived templates, with the plural that the others lack, on a sentence behind each customer's name."""
    rows = _customers(spark, sf_dir).select(F.col("c_custkey").alias("custkey"), F.concat("c_name", F.lit(": ne simțim bine și suntem foarte calm.")).alias("text"))
    words = spark.createDataFrame([("bine", False, ["joy"]), ("calm", False, ["trust"])], "word string, noun boolean, emotions array<string>")
    return patterns.find_matches(rows, words, templates=patterns.archived_templates()).select("custkey", "pattern", "seed")


@query("SELECT c_custkey AS custkey, f AS frame, w AS word FROM customer, (VALUES ('plin_de', 'dor'), ('sentiment_de', 'teama')) t(f, w)")
def archived_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-17: the archived frames that name states, on a sentence behind each customer's name."""
    rows = _customers(spark, sf_dir).select(F.col("c_custkey").alias("custkey"), F.concat("c_name", F.lit(": plin de dor, cu un sentiment de teamă.")).alias("text"))
    return patterns.discover(rows, frames=patterns.ARCHIVED_DISCOVERY).select("custkey", "frame", "word")
