"""Mining new lexicon words: coordinated with known ones, or named by frames; validated by a cascade; repeated to a fix-point."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import scratch
from . import patterns
from .corpus import with_reason

EXAMPLES = 10
# Verb forms (folded) of which one must be among a word's for the bonus.
PRIMARY = ("ma simt", "m-am simtit", "ma simteam", "o sa ma simt")
# Closed-class words (folded) that are no states: pronouns, articles, prepositions, conjunctions, auxiliaries, verbs, adverbs, numerals, others.
STOPWORDS = (
    "eu", "tu", "el", "ea", "noi", "voi", "ei", "ele", "mine", "tine", "sine", "mie", "tie", "sie", "meu", "mea", "mei", "mele",
    "tau", "ta", "tai", "tale", "sau", "sa", "sai", "sale", "lor", "nostru", "noastra", "vostru", "voastra", "se", "ma", "te", "ne", "va",
    "imi", "iti", "ii", "ni", "vi", "le", "care", "ce", "cine", "unde", "cand", "cum", "cat", "cate", "cati",
    "un", "una", "niste", "al", "ai", "ale", "cel", "cea", "cei", "cele", "acest", "aceasta", "acesta", "aceste", "acesti", "acel", "acea", "acei",
    "acele", "acela", "aceea", "fiecare", "oricare", "orice", "niciun", "nicio", "tot", "toata", "toti", "toate", "alt", "alta", "alti", "alte", "altul", "altceva",
    "la", "de", "pe", "cu", "in", "din", "prin", "pentru", "fara", "despre", "peste", "intre", "pana", "dupa", "spre", "sub", "langa", "contra",
    "si", "dar", "ori", "nici", "ca", "daca", "insa", "deci", "asadar", "totusi", "ba", "chiar", "macar", "oare", "nu", "da",
    "am", "are", "avem", "aveti", "au", "sunt", "esti", "este", "suntem", "sunteti", "era", "eram", "erai", "erau", "fost", "fi", "fiu", "fii",
    "fie", "fim", "fiti", "pot", "poti", "poate", "putem", "puteti", "putea", "vrea", "vreau", "vrei", "vrem", "vreti", "vor", "trebuie", "trebui",
    "face", "fac", "faci", "facem", "faceti", "facut", "zice", "zis", "spune", "spus", "stiu", "stie", "stim", "stiti", "cred", "crede", "credem", "avea",
    "aveau", "vin", "vine", "veni",
    "acum", "apoi", "atunci", "ieri", "azi", "maine", "aici", "acolo", "doar", "deja", "inca", "mai", "foarte", "prea", "cam", "destul", "tocmai", "asa",
    "probabil",
    "doi", "doua", "trei", "patru", "cinci",
    "nimic", "nimeni", "nicaieri", "ceva", "asta", "aia",
)
# The archived verb forms of pairs, and the archived closed-class words (folded), in order.
ARCHIVED_VERBS = (r"ma\s+simt", r"m-?am\s+simtit", r"ma\s+simteam", r"sunt", r"eram", r"am\s+fost", r"suntem", r"ne\s+simtim", r"ne-?am\s+simtit")
ARCHIVED_STOPWORDS = (
    "eu", "tu", "el", "ea", "noi", "voi", "ei", "ele", "meu", "mea", "mei", "mele", "tau", "ta", "tai", "tale", "sau", "sa", "sai", "sale", "lor", "nostru", "noastra",
    "mine", "tine", "sine", "mie", "tie", "sie", "care", "ce", "cine", "unde", "cand", "cum", "cat", "cate", "cati", "un", "una", "niste", "al", "ai", "ale",
    "acest", "aceasta", "acesta", "aceste", "acesti", "acel", "acea", "acei", "acele", "acela", "aceea", "cel", "cea", "cei", "cele", "tot", "toata", "toti", "toate", "toat",
    "alt", "alta", "alti", "alte", "altul", "altceva", "fiecare", "oricare", "orice", "niciun", "nicio", "la", "de", "pe", "cu", "in", "din", "prin", "pentru",
    "ca", "daca", "dar", "si", "ori", "nici", "fara", "despre", "peste", "intre", "pana", "dupa", "nu", "mai", "doar", "chiar", "deja", "inca",
    "asa", "asta", "atat", "atata", "apoi", "acum", "aici", "acolo", "sus", "jos", "bine", "rau", "mult", "putin", "des", "rar", "mereu", "niciodata",
    "foarte", "probabil", "sigur", "poate", "oricum", "atunci", "totusi", "insa", "deci", "asadar", "cam", "prea", "destul", "tocmai", "macar", "oare",
    "am", "sunt", "este", "era", "eram", "fost", "are", "avea", "avem", "aveti", "aveau", "face", "fac", "facut", "faci", "facem", "pot", "putea", "putem", "poti",
    "vrea", "vreau", "vrei", "vrem", "vor", "zice", "zis", "spune", "spus", "stiu", "stie", "stim", "stiti", "cred", "crede", "credem", "trebuie", "trebui", "nimic", "nimeni", "nicaieri",
)


def conjunction_evidence(pairs: DataFrame, seeds: DataFrame, source: str | None = None) -> DataFrame:
    """Per y of pairs (x, y, verb_form, …) whose x is a seed (word, gender, emotions): co_seeds, verbs, genders, emotions, n, examples."""
    known = seeds.select(F.col("word").alias("x"), "gender", "emotions")
    joined = pairs.join(known, "x")
    example = F.col(source) if source else F.lit(None).cast("string")
    return joined.groupBy(F.col("y").alias("word")).agg(
        F.array_sort(F.collect_set("x")).alias("co_seeds"), F.array_sort(F.collect_set("verb_form")).alias("verbs"), F.array_sort(F.collect_set("gender")).alias("genders"),
        F.flatten(F.collect_list("emotions")).alias("emotions"), F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set(example)), 1, EXAMPLES).alias("examples"),
    )


def confidence(co_seeds: Column, verbs: Column, n: Column, primary: Column) -> Column:
    return F.least(0.4 * F.least(co_seeds / 5, F.lit(1.0)) + 0.3 * F.least(verbs / 3, F.lit(1.0)) + 0.3 * F.least(n / 5, F.lit(1.0)) + F.when(primary, 0.1).otherwise(0.0), F.lit(1.0))


def stopword_table(spark: SparkSession, words: tuple[str, ...] = STOPWORDS) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def has_primary(verbs: Column, primary: tuple[str, ...] = PRIMARY) -> Column:
    """Whether any of the primary forms occurs in the folded verb forms, joined by spaces."""
    joined = T.normalize(F.array_join(verbs, " "))
    return F.reduce(F.array(*[F.contains(joined, F.lit(p)) for p in primary]), F.lit(False), lambda a, b: a | b)


def validate(evidence: DataFrame, seeds: DataFrame, stopwords: DataFrame, least: int = 2, primary: tuple[str, ...] = PRIMARY, endings: tuple = (T.FEMININE, T.MASCULINE)) -> DataFrame:
    """evidence with gender, reason (the first of the cascade, ``passed`` if none) and confidence.

    too_short, already_in_seed, gender_mismatch (its gender isn't among its co-seeds', or these have none), stopword, low_co_occurrence.
    """
    known = seeds.select("word").distinct().withColumn("_seed", F.lit(True))
    stop = stopwords.select("word").distinct().withColumn("_stop", F.lit(True))
    rows = evidence.join(known, "word", "left").join(stop, "word", "left").withColumn("gender", T.infer_gender(F.col("word"), *endings))
    rules = [
        ("too_short", F.length("word") < 3), ("already_in_seed", F.col("_seed")), ("gender_mismatch", F.col("gender").isNotNull() & ~F.array_contains("genders", F.col("gender"))),
        ("stopword", F.col("_stop")), ("low_co_occurrence", F.size("co_seeds") < least),
    ]
    score = confidence(F.size("co_seeds"), F.size("verbs"), F.col("n"), has_primary(F.col("verbs"), primary))
    return with_reason(rows, rules).withColumn("confidence", score).drop("_seed", "_stop")


def frame_confidence(known: Column, category: Column) -> Column:
    """0.9 for a known seed, 0.7 for a primary template, 0.5 otherwise."""
    return F.when(known, 0.9).when(category == "primary", 0.7).otherwise(0.5)


def vote(emotions: Column, share: float = 0.3) -> Column:
    """The labels that at least that share of the votes has, sorted; ``unknown`` without votes."""
    kept = F.filter(F.array_sort(F.array_distinct(emotions)), lambda e: F.size(F.filter(emotions, lambda x: x == e)) >= share * F.size(emotions))
    return F.when(F.size(emotions) > 0, kept).otherwise(F.array(F.lit("unknown")))


def discovered(found: DataFrame, stopwords: DataFrame, least: int = 3, order: tuple[str, ...] = ("context",)) -> DataFrame:
    """word, frequency, frames, examples (the first 3 by order) of found (word, frame, context, …): 3 to 20 letters, no digit, no stopword."""
    w = F.col("word")
    rows = found.filter((F.length(w) >= 3) & (F.length(w) <= 20) & ~w.rlike(r"\p{Nd}")).join(stopwords.select("word").distinct(), "word", "left_anti")
    example = F.struct(*order, *[c for c in ("context",) if c not in order])
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("frequency"), F.array_sort(F.collect_set("frame")).alias("frames"), F.slice(F.array_sort(F.collect_set(example)), 1, 3).alias("examples")).filter(F.col("frequency") >= least)


def bootstrap(docs: DataFrame, seeds: DataFrame, stopwords: DataFrame, rounds: int = 4, least: int = 2, primary: tuple[str, ...] = PRIMARY, endings: tuple = (T.FEMININE, T.MASCULINE), **frames) -> tuple[DataFrame, DataFrame]:
    """(lexicon, provenance) after at most that many rounds, or the first one that adds no word.

    seeds: word (folded), gender, emotions. The texts are scanned once, for pairs of any words, which are written to the shared folder. A
    round looks the current words up in them, validates what it finds, and adds what passes with its voted emotions. The words of a round
    are written and read again, too, so plans don't grow; a lexicon is small by nature and its words become parameters of the next look-up.
    """
    spark, folder, history = docs.sparkSession, f"{scratch(docs.sparkSession)}/bootstrap-{uuid.uuid4().hex}", []
    current = seeds.select("word", "gender", "emotions")
    text = frames.get("text", "text")
    patterns.pair_places(docs.select(text), **frames).write.parquet(f"{folder}/places")
    places = spark.read.parquet(f"{folder}/places")
    for i in range(1, rounds + 1):
        words = sorted(r["word"] for r in current.select("word").distinct().collect())
        pairs = patterns.pairs_at(places, words, **frames)
        checked = validate(conjunction_evidence(pairs, current), current, stopwords, least, primary, endings)
        checked.write.parquet(f"{folder}/checked-{i}")
        checked = spark.read.parquet(f"{folder}/checked-{i}")
        new = checked.filter("reason = 'passed'").select("word", F.coalesce("gender", F.lit("m")).alias("gender"), vote(F.col("emotions")).alias("emotions"))
        rejected = {r["reason"]: r["n"] for r in checked.filter("reason <> 'passed'").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
        totals = checked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("reason") == "passed").alias("accepted")).first()
        history.append((i, len(words), len(words) + totals["accepted"], totals["matches"], totals["candidates"], totals["accepted"], rejected))
        if not totals["accepted"]:
            break
        current.unionByName(new).write.parquet(f"{folder}/lexicon-{i}")
        current = spark.read.parquet(f"{folder}/lexicon-{i}")
    return current, spark.createDataFrame(history, "round int, seed_size_before int, seed_size_after int, conjunction_matches bigint, unique_candidates bigint, accepted bigint, rejected_reasons map<string,bigint>")


def bootstrap_and_extract(docs: DataFrame, seeds: DataFrame, stopwords: DataFrame, rounds: int = 4, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, lexicon, provenance): the rounds of ``bootstrap``, then all matches of the templates with the grown lexicon."""
    grown, history = bootstrap(docs, seeds, stopwords, rounds)
    return patterns.candidates(docs, patterns.with_nouns(grown), **options), grown, history


def archived_bootstrap(docs: DataFrame, seeds: DataFrame, rounds: int = 4, **options) -> tuple[DataFrame, DataFrame]:
    """``bootstrap`` with the archived miner's verb forms, closed-class words and gender endings."""
    return bootstrap(docs, seeds, stopword_table(docs.sparkSession, ARCHIVED_STOPWORDS), rounds, verbs=ARCHIVED_VERBS, endings=T.ARCHIVED_ENDINGS, **options)
