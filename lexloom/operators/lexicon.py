"""Lexicons: expansion to word forms, synset mapping, merging of sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .corpus import first_by

POS_ORDER = ("adjective", "noun", "adverb")


def adjective_form(msd: Column) -> Column:
    """Singular, without article, neither oblique nor vocative, by the positions of a morphological tag."""
    return (F.length(msd) >= 6) & (F.substring(msd, 6, 1) == "s") & F.endswith(msd, F.lit("n")) & ~F.substring(msd, 7, 1).isin("o", "v")


def noun_form(msd: Column) -> Column:
    return (F.length(msd) >= 5) & (F.substring(msd, 5, 1) == "s") & F.endswith(msd, F.lit("n"))


def forms(lexicon: DataFrame, morphology: DataFrame) -> DataFrame:
    """lexicon (word, pos, …) with form: the word itself, its usable forms in morphology (form, lemma, msd), for adjectives without
    any the regular feminine, and all of these without diacritics."""
    fits = ((F.col("pos") == "adjective") & F.startswith("msd", F.lit("A")) & adjective_form(F.col("msd"))) | ((F.col("pos") == "noun") & F.startswith("msd", F.lit("N")) & noun_form(F.col("msd"))) | ((F.col("pos") == "adverb") & F.startswith("msd", F.lit("R")))
    listed = lexicon.join(morphology, F.col("word") == F.col("lemma")).filter(fits & (F.col("form") != F.col("word"))).select(*lexicon.columns, "form")
    bare = lexicon.filter(F.col("pos") == "adjective").join(listed.select("word", "pos").distinct(), ["word", "pos"], "left_anti")
    regular = bare.withColumn("form", T.feminine_form(F.col("word"))).filter("form IS NOT NULL").select(*lexicon.columns, "form")
    every = lexicon.withColumn("form", F.col("word")).unionByName(listed).unionByName(regular)
    return every.unionByName(every.withColumn("form", T.remove_diacritics(F.col("form")))).distinct()


def expand(lexicon: DataFrame, morphology: DataFrame | None) -> DataFrame:
    """word (folded form), noun, emotions for a matcher, of lexicon (word, pos, emotions).

    A word is expanded as the first part of speech (adjective, noun, adverb) that gives it more than one form. Emotions merge by form.
    Nouns count as nouns in their own form only. Without morphology words stay as they are.
    """
    own = lexicon.select(T.normalize(F.col("word")).alias("word"), (F.col("pos") == "noun").alias("noun"), "emotions")
    if morphology is not None:
        order = F.array_position(F.array(*map(F.lit, POS_ORDER)), F.col("as_pos"))
        trials = lexicon.select("word", "emotions", F.explode(F.array(*map(F.lit, POS_ORDER))).alias("as_pos"))
        made = forms(trials.select("word", F.col("as_pos").alias("pos")).distinct(), morphology)
        rich = made.groupBy("word", "pos").agg(F.count_distinct(T.remove_diacritics(F.col("form"))).alias("k")).filter("k > 1").withColumnRenamed("pos", "as_pos")
        best = first_by(rich, ["word"], [order]).select("word", F.col("as_pos").alias("pos"))
        more = made.join(best, ["word", "pos"]).join(lexicon.select("word", "emotions"), "word").select(T.normalize(F.col("form")).alias("word"), F.lit(False).alias("noun"), "emotions")
        own = own.unionByName(more)
    return own.groupBy("word").agg(F.bool_or("noun").alias("noun"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("emotions")))).alias("emotions"))


def map_synsets(synsets: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapped, unmapped) of synsets (pos, off16, category, ord) over mapping (pos, off16, off30): per target the last category wins."""
    joined = synsets.join(mapping, ["pos", "off16"])
    mapped = joined.groupBy("pos", "off30").agg(F.max_by("category", "ord").alias("category"))
    return mapped, synsets.join(mapping, ["pos", "off16"], "left_anti")


def inherit_category(rows: DataFrame) -> DataFrame:
    """rows (id, noun_id, category): a row without category takes that of the row its noun_id names; without one it goes."""
    nouns = rows.filter("category IS NOT NULL").select(F.col("id").alias("_n"), F.col("category").alias("_c"))
    return rows.join(nouns, F.col("noun_id") == F.col("_n"), "left").withColumn("category", F.coalesce("category", "_c")).drop("_n", "_c").filter("category IS NOT NULL")


def ancestors(edges: DataFrame, view: str = "_taxonomy") -> DataFrame:
    """name, ancestor, depth of a taxonomy of edges (name, parent), by a recursive query."""
    edges.createOrReplaceTempView(view)
    return edges.sparkSession.sql(f"WITH RECURSIVE up(name, ancestor, depth) AS (SELECT name, parent, 1 FROM {view} WHERE parent IS NOT NULL UNION ALL SELECT u.name, e.parent, u.depth + 1 FROM up u JOIN {view} e ON u.ancestor = e.name WHERE e.parent IS NOT NULL) SELECT * FROM up")


def union_by_priority(sources: list[DataFrame], key: str = "word", order: str | None = None) -> DataFrame:
    """The first source that has a key gives its row; within a source the least by order."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("_prio", F.lit(i)) for i, s in enumerate(sources)])
    return first_by(both, [T.normalize(F.col(key))], ["_prio", order or key]).drop("_prio")


def overlay(sources: list[DataFrame], key: str = "word") -> DataFrame:
    """As union_by_priority, but the last source wins, as when dictionaries are laid over each other."""
    return union_by_priority(sources[::-1], key)


def merge_discoveries(bootstrapped: DataFrame, distributional: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """word, confidence, methods, emotions, gender of a full outer join on folded words, without those of seeds (word).

    bootstrapped: word, confidence, emotions, gender; distributional: word, frequency, and perhaps emotions (``discovered`` without).
    Found by both: the first one's confidence (0.5 if it has none) and 0.2 more, 1 at most, and the first one's emotions, then the
    other's new ones; by frequency alone: a tenth of it, 0.8 at most, to three places.
    """
    other = F.col("emotions") if "emotions" in distributional.columns else F.lit(None).cast("array<string>")
    a = bootstrapped.select(T.normalize(F.col("word")).alias("word"), F.coalesce("confidence", F.lit(0.5)).alias("conf"), F.coalesce("emotions", F.array().cast("array<string>")).alias("first"), "gender")
    b = distributional.select(T.normalize(F.col("word")).alias("word"), "frequency", other.alias("second"))
    one, two = F.col("conf").isNotNull(), F.col("frequency").isNotNull()
    confidence = F.when(one & two, F.least(F.col("conf") + 0.2, F.lit(1.0))).when(one, F.col("conf")).otherwise(F.round(F.least(F.col("frequency") / 10, F.lit(0.8)), 3))
    methods = F.array_compact(F.array(F.when(one, "bootstrapping"), F.when(two, "distributional")))
    none = F.array().cast("array<string>")
    emotions = F.when(one & two, F.array_union("first", F.coalesce("second", none))).when(one, F.col("first")).otherwise(F.coalesce("second", F.array(F.lit("discovered"))))
    both = a.join(b, "word", "full_outer")
    if seeds is not None:
        both = both.join(seeds.select(T.normalize(F.col("word")).alias("word")).distinct(), "word", "left_anti")
    return both.select("word", confidence.alias("confidence"), methods.alias("methods"), emotions.alias("emotions"), "gender")


def enrich(seed: DataFrame, merged: DataFrame) -> DataFrame:
    """seed (word, pos, category) and the new words of merged with a guessed part of speech.

    A gender makes an adjective; else a word found by distribution is a noun; else an adjective. The category is the first emotion, or
    ``discovered``.
    """
    new = merged.join(seed.select(T.normalize(F.col("word")).alias("word")).distinct(), "word", "left_anti")
    pos = F.when(F.col("gender").isin("m", "f"), "adjective").when(F.array_contains("methods", "distributional"), "noun").otherwise("adjective")
    return seed.select("word", "pos", "category").unionByName(new.select("word", pos.alias("pos"), F.coalesce(F.get("emotions", F.lit(0)), F.lit("discovered")).alias("category")))


def words_to_emotions(lexicons: list[DataFrame]) -> DataFrame:
    """word, emotions: the union of the sets over all lexicons (word, emotions)."""
    both = reduce(lambda a, b: a.unionByName(b), [x.select("word", "emotions") for x in lexicons])
    return both.groupBy("word").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("emotions")))).alias("emotions"))


def affect_words(lexicon: DataFrame, synsets: DataFrame) -> DataFrame:
    """word, pos, category of lexicon (word, pos, offset) joined to synsets (pos, off30, category); a word may have several categories."""
    return lexicon.join(synsets.select("pos", F.col("off30").alias("offset"), "category"), ["pos", "offset"]).select("word", "pos", "category").distinct()


def of_tags(df: DataFrame, tags: list[str], column: str = "tags") -> DataFrame:
    """Rows of which any tag is among tags."""
    return df.filter(F.arrays_overlap(column, F.array(*map(F.lit, tags))))


def from_pairs(pairs: DataFrame) -> DataFrame:
    """word, gender, emotions of pairs (masculine, feminine, emotions): a row for each form that is there; equal forms are one."""
    forms_ = F.array(F.struct(F.col("masculine").alias("word"), F.lit("m").alias("gender")), F.struct(F.col("feminine").alias("word"), F.lit("f").alias("gender")))
    rows = pairs.select(F.explode(forms_).alias("f"), "emotions").filter(F.col("f.word").isNotNull())
    return rows.groupBy(F.col("f.word").alias("word")).agg(F.min("f.gender").alias("gender"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("emotions")))).alias("emotions"))


def coverage(words: DataFrame) -> DataFrame:
    """emotion, n: how many words (word, emotions) carry each emotion."""
    return words.select(F.explode("emotions").alias("emotion")).groupBy("emotion").agg(F.count(F.lit(1)).alias("n"))


def words_of(words: DataFrame, emotion: str) -> DataFrame:
    """The words that carry an emotion."""
    return words.filter(F.array_contains("emotions", emotion)).select("word")


def first_source(sources: list[tuple[str, Callable[[], DataFrame]]], columns: list[str]) -> tuple[str, DataFrame]:
    """(name, rows) of the first of several sources that is there and has a row with all columns set; each is a reader, the best first.

    A source that doesn't exist, can't be read, or is empty is passed over. Without any, the last one's error is raised, if it has one.
    """
    failed: Exception | None = None
    for name, read in sources:
        try:
            rows = read().select(*columns).dropna()
            if not rows.isEmpty():
                return name, rows
        except (AnalysisException, PySparkException, FileNotFoundError) as error:
            failed = error
    raise LookupError(f"none of {[n for n, _ in sources]} has rows") from failed
