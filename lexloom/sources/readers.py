"""Readers of mixed corpora. Each returns corpus rows (id, text, source, split, original_labels) with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Label names of the seven-bit vectors, in order of their bits.
SEVEN = ("Tristețe", "Surpriză", "Frică", "Furie", "Neutru", "Încredere", "Bucurie")

REVIEWS = "reviews array<struct<index:string,title:string,content:string,starRating:bigint>>"
NEWS = "index string, full_text string, label string"
TWEETS = "Tweet string, Emotion string"
MULTI = "text string, text_id string, agreed_labels array<int>, sum_labels array<int>, procentual_labels array<double>"
SENTIMENT = "index string, text string, label string"
FORUM = "TEXT string, SUBDIALECT string, STATUS string, LABELS string, `PERSONAL INCLINATION` string"
CRAWL = "raw_content string, url string, title string, source_domain string, length bigint, language_score double, digest string"
PAGE = "result array<struct<id:string,title:string,channelname:string,viewcount:bigint,duration:bigint,uploaddate:string,hits:array<struct<start:string,dur:string,ctx_before:string,token:string,ctx_after:string>>,subtitles:array<struct<start:string,dur:string,ctx_before:string,token:string,ctx_after:string>>>>"
LEXICON = "adjectives map<string,string>, nouns map<string,string>, adverbs map<string,string>"
RECORD = "id string, text string, full_context string, raw_content string, source string, split string"


#: Bytes for each core below which a table may be a single piece of a file.
SPLIT_BYTES = 16 << 20


#: As SPLIT_BYTES, of tables whose rows are so short that many of them fill a piece.
SHORT_BYTES = 1 << 20


def spread(df: DataFrame, piece: int | None = None) -> DataFrame:
    """df dealt to all cores if it is small, as a small file may be one piece that one task reads; larger tables come in pieces enough.
    piece: df dealt in pieces of about so many bytes, however large it is.

    For operators that work hard on each row. Only the layout changes, never the rows.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if piece is not None:
        return df.repartition(max(cores, size // piece + 1))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def pieces(df: DataFrame, piece: int = SHORT_BYTES) -> int:
    """How many pieces of about so many bytes df makes; one for each core at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(df.sparkSession.sparkContext.defaultParallelism, size // piece + 1)


def in_order(df: DataFrame, key: str) -> DataFrame:
    """df sorted by key in pieces of which a core holds many: a writer's files, by their names, are in that order, and none is the whole table.

    Read them with numbers that go on from file to file (see ``numbered``).
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, size // (SPLIT_BYTES // 4) + 1)  # rows as text are several times as large as in a columnar file
    return df.repartitionByRange(pieces, key).sortWithinPartitions(key)


def stem() -> Column:
    """The file's name without folder and ending."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1)


def placed(df: DataFrame) -> DataFrame:
    """df, as a reader returns it, with where its rows lie: _file, _block (a split's first byte), _at (order within a split)."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))


#: Bytes of a table of splits that is sent to all executors, and of a row of it.
SPLITS_BYTES, SPLIT_ROW = 64 << 20, 256


def _few_splits(df: DataFrame) -> bool:
    """Whether the files behind df can be in so few splits that a row for each may be broadcast; from their sizes, before anything is read."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return (size // max(1, most) + len(df.inputFiles())) * SPLIT_ROW * 2 <= SPLITS_BYTES


def numbered(df: DataFrame, out: str = "_n", keep: bool = False, across: bool = False) -> DataFrame:
    """df (see ``placed``) with each row's number among the rows of its file, from 0, however the file is split. The place columns go, unless keep.
    across: numbers go on from file to file, by their names.

    A split's rows lie side by side in a task, so a row's number in it is its distance from the split's first row; where a split begins
    follows from the counts of those before it. Rows don't move: they meet a table of one row per split.
    """
    sizes = df.groupBy(F.col("_file").alias("_f"), F.col("_block").alias("_b")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    whole = Window.orderBy("_f", "_b") if across else Window.partitionBy("_f").orderBy("_b")  # over a row for each split
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.select("_f", "_b", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_head"))
    heads = F.broadcast(heads) if _few_splits(df) else heads
    rows = df.join(heads, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")), "left").withColumn(out, F.col("_head") + F.col("_at") - F.col("_first"))
    return rows.drop("_f", "_b", "_head", "_first", *([] if keep else ["_file", "_block", "_at"]))


def _rows(df: DataFrame, source: str, number: Column, text: Column, split: Column, labels: Column) -> DataFrame:
    out = df.select(F.concat_ws("_", F.lit(source), number).alias("id"), text.alias("text"), F.lit(source).alias("source"), split.alias("split"), labels.alias("original_labels"))
    return out.filter(F.length(T.strip(F.col("text"))) > 0)


def _csv(spark: SparkSession, path: str | list[str], schema: str, **options) -> DataFrame:
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", **options).schema(schema).csv(path)


def _labels(**columns: Column) -> Column:
    """map<string,string> of the labels that are there."""
    made = F.create_map(*[x for name, c in columns.items() for x in (F.lit(name), c.cast("string"))])
    return F.map_filter(made, lambda k, v: v.isNotNull())


def jsonl(spark: SparkSession, path: str | list[str], sources: list[str] | None = None, most: int | None = None, triggers: tuple[str, ...] = ()) -> DataFrame:
    """Corpus lines (any of three text fields) with id by default stem and number, source by default stem; broken, blank and empty lines go.

    The number counts the file's lines that stay. most: the first ones by file and number. triggers: substrings of which a text in lower case must hold one.
    """
    df = spark.read.schema(RECORD + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path).withColumn("_stem", stem())
    if sources:
        df = df.filter(F.col("_stem").isin(*sources))
    df = df.withColumn("text", T.first_non_empty(F.col("text"), F.col("full_context"), F.col("raw_content"))).filter(F.col("_corrupt_record").isNull() & (F.length(T.strip(F.col("text"))) > 0))
    if triggers:
        df = df.filter(F.reduce(F.array(*[F.contains(F.lower("text"), F.lit(t)) for t in triggers]), F.lit(False), lambda x, y: x | y))
    rows = numbered(placed(df), keep=True)
    if most is not None:
        rows = rows.orderBy("_file", "_n").limit(most)
    return rows.select(F.coalesce("id", F.concat_ws("_", "_stem", "_n")).alias("id"), "text", F.coalesce("source", "_stem").alias("source"), "split")


def broken_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """n_lines, n_blank, n_broken of JSON lines."""
    raw = spark.read.text(path)
    line = F.trim("value")
    broken = (line != "") & F.try_parse_json(line).isNull()
    return raw.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(line == "").alias("n_blank"), F.count_if(broken).alias("n_broken"))


def reviews(spark: SparkSession, paths: dict[str, str], source: str = "laroseda") -> DataFrame:
    """JSON objects with reviews, by label; text is title and content on two lines, or the one that isn't empty."""
    out = None
    for label, path in paths.items():
        one = spark.read.schema(REVIEWS).option("multiLine", True).json(path).select(F.explode("reviews").alias("r"))
        text = F.concat_ws("\n", T.non_empty(F.col("r.title")), T.non_empty(F.col("r.content")))
        rows = _rows(one, source, F.concat_ws("_", F.lit(label), "r.index"), text, F.lit(None).cast("string"), _labels(label=F.lit(label), stars=F.col("r.starRating")))
        out = rows if out is None else out.unionByName(rows)
    return out


def news(spark: SparkSession, paths: dict[str, str], source: str = "poprero") -> DataFrame:
    out = None
    for split, path in paths.items():
        df = _csv(spark, path, NEWS)
        rows = _rows(df, source, F.concat_ws("_", F.lit(split), "index"), F.col("full_text"), F.lit(split), _labels(label=F.col("label")))
        out = rows if out is None else out.unionByName(rows)
    return out


def tweets(spark: SparkSession, paths: dict[str, str], source: str = "red_v1", across: bool = False) -> DataFrame:
    """The row's number in its file counts from 0 and makes the id (across: see ``numbered``); split val is validation."""
    out = None
    for split, path in paths.items():
        df = numbered(placed(_csv(spark, path, TWEETS)), across=across)
        name = "validation" if split == "val" else split
        rows = _rows(df, source, F.concat_ws("_", F.lit(name), F.col("_n").cast("string")), F.col("Tweet"), F.lit(name), _labels(emotion=F.col("Emotion")))
        out = rows if out is None else out.unionByName(rows)
    return out


def bits_to_names(bits: Column, names: tuple[str, ...] = SEVEN) -> Column:
    return F.filter(F.transform(F.array(*map(F.lit, names)), lambda n, i: F.when(F.get(bits, i) == 1, n)), lambda n: n.isNotNull())


def multilabel_tweets(spark: SparkSession, paths: dict[str, str], source: str = "red_v2") -> DataFrame:
    out = None
    for split, path in paths.items():
        df = spark.read.schema(MULTI).option("multiLine", True).json(path)
        rows = _rows(df, source, F.concat_ws("_", F.lit(split), "text_id"), F.col("text"), F.lit(split), _labels(emotions=F.array_join(bits_to_names(F.col("agreed_labels")), ",")))
        out = rows if out is None else out.unionByName(rows)
    return out


def sentiment(spark: SparkSession, paths: dict[str, str], source: str = "ro_sent") -> DataFrame:
    out = None
    for split, path in paths.items():
        df = _csv(spark, path, SENTIMENT)
        rows = _rows(df, source, F.concat_ws("_", F.lit(split), "index"), F.col("text"), F.lit(split), _labels(label=F.col("label").try_cast("int")))
        out = rows if out is None else out.unionByName(rows)
    return out


def forum(spark: SparkSession, path: str, source: str = "reddit_roap", across: bool = False) -> DataFrame:
    """The row's number in its file counts from 0 and makes the id; across: see ``numbered``."""
    df = spark.read.schema(FORUM).parquet(path)
    df = numbered(placed(df), across=True) if across else df.withColumn("_n", F.col("_metadata.row_index"))
    return _rows(df, source, F.col("_n").cast("string"), F.col("TEXT"), F.lit(None).cast("string"), _labels(subdialect=F.col("SUBDIALECT"), status=F.col("STATUS"), labels=F.col("LABELS"), inclination=F.col("`PERSONAL INCLINATION`")))


def crawl(df: DataFrame, least_score: float = 0.0, shortest: int = 0, longest: int = 0, most: int | None = None, number: str | None = None) -> DataFrame:
    """Rows of a crawl (see CRAWL), batch or stream, in corpus form; thresholds of 0 are off; id by digest, else by number, a column of the
    row's place in the crawl (see ``numbered``), if there is one, else by url."""
    keep = F.lit(True)
    if least_score:
        keep = keep & (F.coalesce("language_score", F.lit(0.0)) >= least_score)
    if shortest:
        keep = keep & (F.length("raw_content") >= shortest)
    if longest:
        keep = keep & (F.length("raw_content") <= longest)
    place = [F.col(number).cast("string")] if number else []
    ident = F.concat(F.lit("fulg_"), F.coalesce(T.non_empty(F.substring("digest", 1, 12)), *place, F.substring(F.md5(F.col("url").cast("binary")), 1, 12)))
    out = df.filter(keep & (F.length(T.strip(F.col("raw_content"))) > 0)).select(ident.alias("id"), F.col("raw_content").alias("text"), F.lit("fulg").alias("source"), "url", "title", "source_domain", F.col("length").alias("full_text_length"), "language_score")
    return out.limit(most) if most is not None else out


def crawl_files(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Landed crawl records (JSON lines) in corpus form; a record without digest is named by its place among all records, also those that go.

    options: of ``crawl``.
    """
    rows = numbered(placed(spark.read.schema(CRAWL).json(path)), across=True)
    return crawl(rows, number="_n", **options)


def parsed_page(body: Column) -> Column:
    """An API page (see PAGE) from JSON, with the fields' other names read as well."""
    for other, name in (("channelName", "channelname"), ("viewCount", "viewcount"), ("publishDate", "uploaddate")):
        body = F.replace(body, F.lit(f'"{other}"'), F.lit(f'"{name}"'))
    return F.from_json(body, PAGE)


def subtitle_hits(pages: DataFrame) -> DataFrame:
    """A row per hit of API pages (see PAGE; query carried along if there), with joined context and a link to the second."""
    query = F.col("query") if "query" in pages.columns else F.lit(None).cast("string")
    videos = pages.select(query.alias("query"), F.explode("result").alias("v"))
    hits = videos.select("query", "v", F.explode(F.coalesce("v.hits", "v.subtitles")).alias("h"))
    second = F.floor(F.col("h.start").try_cast("double")).cast("int")
    context = F.trim(F.concat_ws(" ", T.non_empty(F.trim("h.ctx_before")), T.non_empty(F.trim("h.token")), T.non_empty(F.trim("h.ctx_after"))))
    return hits.select(
        F.col("v.id").alias("video_id"), F.col("v.title").alias("video_title"), F.col("v.channelname").alias("channel_name"), "query", F.col("h.start").try_cast("double").alias("hit_start"),
        F.col("h.dur").try_cast("double").alias("hit_dur"), "h.ctx_before", "h.token", "h.ctx_after", context.alias("full_context"), F.concat(F.lit("https://www.youtube.com/watch?v="), "v.id", F.lit("&t="), second.cast("string"), F.lit("s")).alias("youtube_url"),
        F.col("v.viewcount").alias("view_count"), "v.duration", F.col("v.uploaddate").alias("upload_date"),
    )


def morphology(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("form string, lemma string, msd string").option("sep", "\t").option("quote", "").csv(path)
    return df.filter("msd IS NOT NULL").withColumn("lemma", F.when(F.col("lemma") == "=", F.col("form")).otherwise(F.col("lemma")))


def synset_map(spark: SparkSession, path: str, pos: str) -> DataFrame:
    """pos, off16, off30, conf of lines ``offset (offset confidence)+``."""
    parts = F.split(F.trim("value"), r"\s+")
    pairs = F.transform(F.sequence(F.lit(1), F.size("p") - 2, F.lit(2)), lambda i: F.struct(F.get("p", i).try_cast("int").alias("off30"), F.get("p", i + 1).try_cast("double").alias("conf")))
    return spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= 3).select(F.lit(pos).alias("pos"), F.get("p", F.lit(0)).try_cast("int").alias("off16"), F.explode(pairs).alias("t")).select("pos", "off16", "t.off30", "t.conf")


def taxonomy(spark: SparkSession, path: str, tag: str = "categ") -> DataFrame:
    """name, parent of an XML tree of categories."""
    return spark.read.format("xml").option("rowTag", tag).schema("_name string, _isa string").load(path).select(F.col("_name").alias("name"), F.col("_isa").alias("parent"))


def affect_synsets(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """id, noun_id, category of an XML list of synsets."""
    df = spark.read.format("xml").option("rowTag", tag).schema("_id string, `_noun-id` string, _categ string").load(path)
    return df.select(F.col("_id").alias("id"), F.col("`_noun-id`").alias("noun_id"), F.col("_categ").alias("category"))


def affect_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, pos, offset of a semicolon CSV; only full synset ids of adjectives, nouns and adverbs."""
    df = spark.read.options(header=True, sep=";").schema("word string, part_of_speech string, wn_synset_id string").csv(path)
    offset = F.regexp_extract("wn_synset_id", r"^ENG30-(\d+)", 1).try_cast("int")
    return df.filter(F.col("part_of_speech").isin("Adjective", "Noun", "Adverb")).select("word", F.lower("part_of_speech").alias("pos"), offset.alias("offset")).filter("offset IS NOT NULL")


def sniffed_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A CSV whose separator is the commoner of comma and semicolon in its first 2048 characters; columns by the first alias that is there."""
    first = "\n".join(r[0] for r in spark.read.text(path).limit(2048).collect())[:2048]
    sep = ";" if first.count(";") > first.count(",") else ","
    df = spark.read.options(header=True, sep=sep).csv(path)
    have = {c.strip().lower(): c for c in df.columns}
    picks = {out: next((have[a.lower()] for a in names if a.lower() in have), None) for out, names in aliases.items()}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(out) for out, c in picks.items()])


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("1", "true", "yes", "y", "x", "da")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """id, score of an annotator's CSV, perhaps in several files: the set one of four columns, else the text column; an id's last row counts, by the files' names and its place."""
    names = ("not_affect", "unlike_affect", "like_affect", "is_affect")
    df = numbered(placed(spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)), across=True)
    have = set(df.columns)
    score = F.lit(None).cast("int")
    fallback = F.col("`Answer.affect`") if "Answer.affect" in have else F.lit(None).cast("string")
    for i, n in reversed(list(enumerate(names))):
        score = F.when(fallback == n, i).otherwise(score)
    for i, n in reversed(list(enumerate(names))):
        if f"Answer.affect.{n}" in have:
            score = F.when(F.lower(F.col(f"`Answer.affect.{n}`")) == "true", i).otherwise(score)
    return df.groupBy(F.col("`Input.id`").alias("id")).agg(F.max_by(score, "_n").alias("score"))


def labelled_csv(spark: SparkSession, path: str, language: str) -> DataFrame:
    """id, input, labels (array), n_masks, language of a CSV with list literals and perhaps a byte order mark."""
    df = spark.read.options(header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select("id", "input", T.literal_list(F.col("labels")).alias("labels"), F.regexp_count("input", F.lit(r"\[MASK\]")).alias("n_masks"), F.lit(language).alias("language"))


def translated(df: DataFrame, names: list[str], suffix: str = "_en") -> DataFrame:
    """df with the columns that have a translated twin replaced by it."""
    twins = {c: F.coalesce(f"{c}{suffix}", c) for c in names if f"{c}{suffix}" in df.columns}
    return df.withColumns(twins).drop(*[f"{c}{suffix}" for c in twins])


def lexicon_emotions(spark: SparkSession, path: str) -> DataFrame:
    """word, pos, emotions of a JSON object of three maps; a word's value is a string or an array."""
    df = spark.read.schema(LEXICON).option("multiLine", True).json(path)
    parts = [df.select(F.explode(kind), F.lit(pos).alias("pos")).select(F.col("key").alias("word"), "pos", T.listed(F.col("value")).alias("emotions")) for kind, pos in (("adjectives", "adjective"), ("nouns", "noun"), ("adverbs", "adverb"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    """word, pos, category of a JSON object of three maps; of an array the first is the category."""
    return lexicon_emotions(spark, path).select("word", "pos", F.get("emotions", F.lit(0)).alias("category"))


def metric_files(spark: SparkSession, path: str) -> DataFrame:
    """name and numbers of every ``*_metrics.json`` in a folder."""
    df = spark.read.schema("acc_at_1 double, acc_at_3 double, acc_at_5 double, mrr double, n bigint").option("multiLine", True).option("pathGlobFilter", "*_metrics.json").json(path)
    return df.select(stem().alias("name"), "*").withColumn("name", F.regexp_replace("name", "_metrics$", ""))


def preferred(df: DataFrame, key: str, kind: str, order: list[str], text: str = "text", shortest: int = 0) -> DataFrame:
    """Of each key's transcripts that are long enough, the first kind in order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(kind))
    w = Window.partitionBy(key).orderBy(place, text)
    return df.filter((place > 0) & (F.length(text) >= shortest)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def masked_pool(spark: SparkSession, path: str, prefix: str = "hindi", across: bool = False) -> DataFrame:
    """id, input, labels of a CSV (sentence, emotion_word, source): the token that holds the word is masked and is the only label.

    id: prefix, the source up to its first hyphen in small letters, and the row's number in the file; across: see ``numbered``.
    """
    df = numbered(placed(_csv(spark, path, "sentence string, emotion_word string, source string")), across=across)
    sentence, word = F.col("sentence"), F.col("emotion_word")
    ident = F.concat_ws("_", F.lit(prefix), F.lower(F.substring_index("source", "-", 1)), F.col("_n").cast("string"))
    return df.select(ident.alias("id"), T.mask_token_with(sentence, word).alias("input"), F.array(T.token_with(sentence, word)).alias("labels"))


def with_cache(wanted: DataFrame, cache: DataFrame, key: str, fetch) -> DataFrame:
    """A row of cache (key, …) for each distinct key of wanted; those that it lacks come from fetch(DataFrame of keys), in the same columns."""
    keys = wanted.select(key).distinct()
    missing = keys.join(cache.select(key), key, "left_anti")
    return cache.join(keys, key, "left_semi").unionByName(fetch(missing).select(*cache.columns))


def video_filter(views: Column, seconds: Column, least_views: int = 0, shortest: int = 0, longest: int = 0) -> Column:
    """0 turns a bound off; an unknown duration passes the shortest."""
    keep = F.lit(True)
    if least_views:
        keep = keep & (F.coalesce(views, F.lit(0)) >= least_views)
    if shortest:
        keep = keep & (seconds.isNull() | (seconds >= shortest))
    if longest:
        keep = keep & (F.coalesce(seconds, F.lit(0)) <= longest)
    return keep


def with_metadata(rows: DataFrame, videos: DataFrame, key: str, columns: list[str], missing: str = "unknown") -> DataFrame:
    """rows with columns of videos (one row a key); where there is none, text columns say missing."""
    joined = rows.join(videos.select(key, *columns), key, "left")
    return joined.fillna(missing, subset=columns)
