import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lexloom.operators import corpus
from lexloom.sources import paging, readers, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    path = write(tmp_path / "one.jsonl", '{"id": "a", "text": "T"}\n\n{"full_context": "C", "text": ""}\nbroken\n{"raw_content": "  "}\n{"raw_content": "R", "source": "s"}\n')
    got = readers.jsonl(spark, path).collect()
    assert sorted((r.id, r.text, r.source) for r in got) == [("a", "T", "one"), ("one_1", "C", "one"), ("one_2", "R", "s")]
    assert [r.id for r in readers.jsonl(spark, path, triggers=("c", "zz")).collect()] == ["one_0"]
    assert readers.jsonl(spark, path, sources=["two"]).count() == 0 and readers.jsonl(spark, path, most=1).count() == 1
    assert tuple(readers.broken_lines(spark, path).first()) == (6, 1, 1)


def test_numbers_hang_on_no_split(spark, tmp_path):
    """Lines of files that are read in many pieces, several files to a task."""
    for name, n in (("long", 4000), ("short", 30)):
        write(tmp_path / f"{name}.jsonl", "".join(f'{{"text": "{name} {i} {"x" * (i % 50)}"}}\n' for i in range(n)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in (before, "7000b"):
            spark.conf.set(key, size)
            got = readers.jsonl(spark, [str(tmp_path / "long.jsonl"), str(tmp_path / "short.jsonl")]).collect()
            assert len(got) == 4030 and all(r.id == "_".join(r.text.split()[:2]) for r in got)
    finally:
        spark.conf.set(key, before)


def test_masked_pool_and_cache(spark, tmp_path):
    path = write(tmp_path / "pool.csv", 'sentence,emotion_word,source\n"वह दुखी। है",दुख,Tale-1\n"a sad day",sad,News\nnone,zzz,X\n')
    got = [tuple(r) for r in readers.masked_pool(spark, path).orderBy("id").collect()]
    assert got == [("hindi_news_1", "a [MASK] day", ["sad"]), ("hindi_tale_0", "वह [MASK]। है", ["दुखी"]), ("hindi_x_2", None, [None])]
    cache = spark.createDataFrame([("a", "A"), ("z", "Z")], "id string, text string")
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    full = readers.with_cache(wanted, cache, "id", lambda keys: keys.withColumn("text", F.upper("id")))
    assert sorted(map(tuple, full.collect())) == [("a", "A"), ("b", "B")]


def test_files_in_order(spark, tmp_path):
    """What one file held lies in several, and places go on from file to file by their names, not by their sizes."""
    readers.in_order(spark.range(1000).select((999 - F.col("id")).alias("n")), "n").select(F.concat(F.lit("a"), "n").alias("sentence"), F.col("n").cast("string").alias("emotion_word"), F.lit("S").alias("source")).write.option("header", True).csv(f"{tmp_path}/pool")
    assert len(list((tmp_path / "pool").glob("part-*.csv"))) > 1
    got = readers.masked_pool(spark, f"{tmp_path}/pool", across=True).collect()
    assert len(got) == 1000 and all(r.id == f"hindi_s_{r.labels[0][1:]}" for r in got)
    head = "Input.id,Answer.affect.not_affect,Answer.affect.is_affect,Answer.affect\n"
    (tmp_path / "said").mkdir()
    write(tmp_path / "said" / "part-0.csv", head + "1,false,true,\n")
    write(tmp_path / "said" / "part-1.csv", head + "1,true,false,\n" + "2,false,true,\n" * 500)
    assert {(r.id, r.score) for r in readers.annotations(spark, f"{tmp_path}/said").collect()} == {("1", 0), ("2", 3)}


def test_small_corpora(spark, tmp_path):
    path = write(tmp_path / "r.json", json.dumps({"reviews": [{"index": "1", "title": "Bun", "content": "Chiar", "starRating": 5}, {"index": "2", "title": "", "content": "Doar", "starRating": 1}, {"index": "3", "title": "", "content": " "}]}))
    got = readers.reviews(spark, {"positive": path}).collect()
    assert [(r.id, r.text) for r in got] == [("laroseda_positive_1", "Bun\nChiar"), ("laroseda_positive_2", "Doar")] and got[0].original_labels == {"label": "positive", "stars": "5"}
    path = write(tmp_path / "n.csv", 'index,full_text,label\n7,"Cu ""ghilimele"" și\nrând nou",popular\n8,,x\n')
    (r,) = readers.news(spark, {"train": path}).collect()
    assert (r.id, r.text, r.split) == ("poprero_train_7", 'Cu "ghilimele" și\nrând nou', "train")
    path = write(tmp_path / "t.csv", "Tweet,Emotion\nunu,Joy\ndoi,Fear\n")
    assert [(r.id, r.split, r.original_labels["emotion"]) for r in readers.tweets(spark, {"val": path}).orderBy("id").collect()] == [("red_v1_validation_0", "validation", "Joy"), ("red_v1_validation_1", "validation", "Fear")]
    path = write(tmp_path / "m.json", json.dumps([{"text": "x", "text_id": "9", "agreed_labels": [1, 0, 0, 0, 0, 0, 1]}]))
    (r,) = readers.multilabel_tweets(spark, {"test": path}).collect()
    assert r.original_labels["emotions"] == "Tristețe,Bucurie"
    path = write(tmp_path / "s.csv", "index,text,label\n1,bine,1\n2,rău,?\n")
    assert [r.original_labels for r in readers.sentiment(spark, {"train": path}).orderBy("id").collect()] == [{"label": "1"}, {}]
    spark.createDataFrame([("text", "RO", None, "l", None)], readers.FORUM).write.parquet(f"{tmp_path}/f")
    (r,) = readers.forum(spark, f"{tmp_path}/f").collect()
    assert r.original_labels == {"subdialect": "RO", "labels": "l"}


def test_crawl_and_subtitles(spark):
    rows = spark.createDataFrame([("text " * 30, "u1", "t", "d", 150, 0.9, "sha1:abcdefghij"), ("scurt", "u2", "t", "d", 5, 0.9, None), ("text " * 30, "u3", "t", "d", 150, None, "x")], readers.CRAWL)
    got = readers.crawl(rows, 0.8, 100).collect()
    assert [r.id for r in got] == ["fulg_sha1:abcdefg"] and readers.crawl(rows).count() == 3 and readers.crawl(rows, most=2).count() == 2
    page = json.dumps({"result": [{"id": "v1", "title": "T", "channelName": "C", "viewcount": 3, "hits": [{"start": "12.7", "dur": 1.5, "ctx_before": " mă simt", "token": "bine", "ctx_after": None}, {"start": "x", "token": "rău"}]}]})
    pages = spark.createDataFrame([("q", page)], "query string, body string").select("query", readers.parsed_page(F.col("body")).alias("p")).select("query", "p.*")
    a, b = readers.subtitle_hits(pages).collect()
    assert (a.full_context, a.youtube_url, a.channel_name, a.hit_start) == ("mă simt bine", "https://www.youtube.com/watch?v=v1&t=12s", "C", 12.7)
    assert b.full_context == "rău" and b.hit_start is None


def test_lexical_files(spark, tmp_path):
    path = write(tmp_path / "m.tsv", "casă\tcasă\tNcfsrn\nbun\t=\tAfpmsrn\nscurt\tx\n")
    assert {(r.form, r.lemma) for r in readers.morphology(spark, path).collect()} == {("casă", "casă"), ("bun", "bun")}
    path = write(tmp_path / "wn.adj", "00001 100 0.9 200 0.1\n00002\n00003 300 1\n")
    assert {(r.off16, r.off30, r.conf) for r in readers.synset_map(spark, path, "a").collect()} == {(1, 100, 0.9), (1, 200, 0.1), (3, 300, 1.0)}
    path = write(tmp_path / "h.xml", '<r><categ name="joy" isa="emotion"/><categ name="root"/></r>')
    assert {(r.name, r.parent) for r in readers.taxonomy(spark, path).collect()} == {("joy", "emotion"), ("root", None)}
    path = write(tmp_path / "l.csv", "word;part_of_speech;wn_synset_id\nbun;Adjective;ENG30-00123-a\nx;Verb;ENG30-1-v\ny;Noun;bad\n")
    assert [(r.word, r.pos, r.offset) for r in readers.affect_lexicon(spark, path).collect()] == [("bun", "adjective", 123)]
    path = write(tmp_path / "s.csv", "Cuvant;POS;joy\nbun;adj;1\n")
    r = readers.sniffed_csv(spark, path, {"word": ["word", "cuvant"], "pos": ["pos"], "none": ["zzz"]}).first()
    assert tuple(r) == ("bun", "adj", None)
    path = write(tmp_path / "lex.json", json.dumps({"adjectives": {"bun": "joy"}, "nouns": {"dor": "sadness"}, "adverbs": {}}))
    mixed = write(tmp_path / "mixed.json", '{"adjectives": {"bun": ["joy", "trust"]}, "nouns": {"dor": "sadness"}}')
    assert sorted((r.word, r.emotions) for r in readers.lexicon_emotions(spark, mixed).collect()) == [("bun", ["joy", "trust"]), ("dor", ["sadness"])]
    assert {tuple(r) for r in readers.lexicon_json(spark, path).collect()} == {("bun", "adjective", "joy"), ("dor", "noun", "sadness")}


def test_evaluation_files(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Input.id,Answer.affect.not_affect,Answer.affect.is_affect,Answer.affect\n1,true,false,\n2,false,true,\n1,false,false,like_affect\n")
    assert {(r.id, r.score) for r in readers.annotations(spark, path).collect()} == {("1", 2), ("2", 3)}
    path = write(tmp_path / "l.csv", "﻿id,input,labels\n1,\"Sunt [MASK] și [MASK].\",\"['trist', 'calm']\"\n")
    (r,) = readers.labelled_csv(spark, path, "ro").collect()
    assert (r.id, r.labels, r.n_masks) == ("1", ["trist", "calm"], 2)
    write(tmp_path / "res" / "mlm_x_metrics.json", json.dumps({"acc_at_1": 0.5, "mrr": 0.6}))
    write(tmp_path / "res" / "other.json", "{}")
    assert [(r["name"], r.mrr) for r in readers.metric_files(spark, f"{tmp_path}/res").collect()] == [("mlm_x", 0.6)]
    df = spark.createDataFrame([("a", "b"), ("c", None)], "text string, text_en string")
    assert [r.text for r in readers.translated(df, ["text", "other"]).collect()] == ["b", "c"]
    kinds = spark.createDataFrame([("v", "generated", "lung " * 9), ("v", "manual", "x"), ("w", "auto", "lung " * 9)], "k string, kind string, text string")
    assert {(r.k, r.kind) for r in readers.preferred(kinds, "k", "kind", ["manual", "generated"], shortest=10).collect()} == {("v", "generated")}
    videos = spark.createDataFrame([(10, None), (10, 5), (1, 500)], "v int, s int")
    assert videos.filter(readers.video_filter(F.col("v"), F.col("s"), 5, 60)).count() == 1


def test_paging(spark, tmp_path):
    full, none = json.dumps({"result": [{"id": "v"}]}), json.dumps({"result": []})
    for query, bodies in {"a": [full, none, full, none, none, full], "b": [full], "c": [full]}.items():
        for i, body in enumerate(bodies, 1):
            write(tmp_path / query / f"{i}.json", body)
    for i, body in enumerate([full, "broken", full], 1):
        write(tmp_path / '"mă + simt"' / f"{i}.json", body)
    write(tmp_path / "gap" / "2.json", full)
    read = paging.landed_pages(spark, str(tmp_path), queries=["a", "b", "c", "zzz"], done=["c"])
    assert {(r.query, r.page) for r in read.collect()} == {("a", 1), ("a", 3), ("b", 1)}
    every = paging.landed_pages(spark, str(tmp_path), most=1)
    assert {(r.query, r.page, r.body) for r in every.collect()} == {(q, 1, full) for q in ("a", "b", "c", '"mă + simt"')}
    assert [p for _, p, _ in paging.pages_of("a", lambda q, p: (tmp_path / q / f"{p}.json").read_text(), 9)] == [1, 3]

    def failing(query, page):
        if page == 2:
            raise OSError("down")
        return full

    assert [p for _, p, _ in paging.pages_of("q", failing, 9)] == [1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "Mă simt bine. Și altele.", "Mă simt bine.", "bine", "web", "train", ["bine"])], "id string, text string, matched_sentence string, seed_word string, source string, split string, labels array<string>")
    sinks.jsonl(df, f"{tmp_path}/j")
    sinks.jsonl(df, f"{tmp_path}/j", resume=True)
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    with pytest.raises(AnalysisException):
        sinks.jsonl_once(df, f"{tmp_path}/j")
    sinks.splits(df, f"{tmp_path}/s", "split", order=("id",))
    assert spark.read.parquet(f"{tmp_path}/s").first().split == "train"
    sinks.annotation_csv(df, f"{tmp_path}/a")
    r = spark.read.options(header=True, escape='"').csv(f"{tmp_path}/a").first()
    span = f'<span style="{sinks.HIGHLIGHT}">bine</span>'
    assert r.short_context == f"<strong>M&#259; simt {span}.</strong><br>" and r.full_context == f"M&#259; simt {span}. &#536;i altele.<br>" and (r.emo_term, r.show_inst) == ("bine", "show")
    long = df.withColumn("text", F.concat(F.repeat(F.lit("a"), 3000), F.lit("Mă simt bine."), F.repeat(F.lit("b"), 4000))).withColumn("title", F.lit("")).withColumn("video_title", F.lit("V"))
    full = sinks.annotation_rows(long).first().full_context
    assert full.startswith("<em>V</em><br><br>" + "a" * 2500 + "M&#259;") and full.endswith("." + "b" * 2500 + "<br>")
    sinks.presentation_csv(df.withColumn("input", F.col("text")), f"{tmp_path}/p")
    assert spark.read.options(header=True, escape='"').csv(f"{tmp_path}/p").first().labels == "['bine']"
    sinks.stats(corpus.counts_by_each(df, "source"), f"{tmp_path}/st")
    assert json.loads(spark.read.text(f"{tmp_path}/st").first()[0]) == {"source": {"web": 1}, "all": {"all": 1}}
    sinks.fan_out(df, f"{tmp_path}/all", f"{tmp_path}/kept", F.col("source") == "x")
    assert spark.read.parquet(f"{tmp_path}/all").count() == 1 and spark.read.parquet(f"{tmp_path}/kept").count() == 0
    sinks.raw_lines(df, f"{tmp_path}/raw", "text")
    table = spark.createDataFrame([("m_1", 0.12345, None)], "model string, acc double, n int")
    assert sinks.markdown(table).splitlines()[2] == "| m_1 | 0.123 |  |" and r"m\_1 & 0.123" in sinks.latex(table)
