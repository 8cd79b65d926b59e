"""All queries of the engine's own operators by name, each with DuckDB SQL where SQL can express it.

The test tables stand in for the corpora: documents for a crawl, labels for raters, pages for urls, conversations for captions,
embeddings for sentence vectors (label 0: anchors), events for a record stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, lexicon, metrics, mining, patterns, sampling, vector
from ..scratch import scratch
from ..sources import readers, sinks
from ..streaming import crawl

FLAGSHIP = "conjunction_evidence"

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _found[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import drivers, files  # noqa: F401  they add theirs

    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: s for k, (_, s) in _found.items() if s is not None}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Words that the English test texts use often; they play the lexicon. The nouns among them play nouns.
SEEDS = ("and", "that", "with", "for", "this", "are", "was", "it")
NOUNS = ("that", "this", "it")
STOP = ("the", "of", "is", "to", "in", "a", "an", "be", "by", "as", "at", "on", "or", "he", "not", "from", "have", "you")
FRAMES = (
    patterns.Template("the_state", "primary", "the"), patterns.Template("of_state", "primary", "of"), patterns.Template("to_state", "secondary", "to"),
    patterns.Template("in_noun", "secondary", "in", True), patterns.Template("of_the_noun", "secondary", "of the", True),
)
_FOLD = "regexp_replace(lower(text), '[^a-z]+', ' ', 'g')"
_WORDS = f"(SELECT doc_id, w, i, lag(w) OVER (PARTITION BY doc_id ORDER BY i) p1, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) p2 FROM (SELECT doc_id, unnest(ws) w, generate_subscripts(ws, 1) i FROM (SELECT doc_id, list_filter(string_split({_FOLD}, ' '), lambda x: x <> '') ws FROM documents)))"


def _folded(spark: SparkSession, sf_dir: str, piece: int | None = None) -> DataFrame:
    docs = readers.spread(_read(spark, sf_dir, "documents").select("doc_id", "text"), piece)
    return docs.select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z]+", " ").alias("text"))


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, w in NOUNS, ["known"]) for w in SEEDS], "word string, noun boolean, emotions array<string>")


def _in(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


# --- Scalars


@query("SELECT doc_id, md5(translate(lower(text), 'ăâîșțĂÂÎȘȚşţŞŢ', 'aaistAAISTstST')) AS normal, md5(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS dedup_key, length(text)::INT AS n FROM documents")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-01, TXT-02, TXT-10, TXT-11."""
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(T.normalize(F.col("text")).cast("binary")).alias("normal"), T.dedup_key(F.col("text")).alias("dedup_key"), F.length("text").alias("n"))


_DOMAIN_SQL = "CASE " + " ".join(f"WHEN regexp_matches(x, '{'|'.join(shapes)}') THEN '{kind}'" for kind, shapes in T.DOMAINS) + " ELSE 'other' END"


@query(f"SELECT kind, count(*) AS n FROM (SELECT {_DOMAIN_SQL} AS kind FROM (SELECT lower(concat_ws(' ', regexp_extract(url, '://([^/]+)', 1), url)) x FROM pages)) GROUP BY kind")
def domain_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-09, AGG-01."""
    return corpus.counts(_read(spark, sf_dir, "pages").withColumn("kind", T.domain_kind(F.regexp_extract("url", "://([^/]+)", 1), F.col("url"))), "kind")


@query("SELECT item_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) > 127 THEN '&#' || unicode(c) || ';' ELSE c END), '') AS escaped, CASE WHEN strpos(lower(text), 'the') > 0 THEN substr(text, 1, strpos(lower(text), 'the') - 1) || '<b>' || substr(text, strpos(lower(text), 'the'), 3) || '</b>' || substr(text, strpos(lower(text), 'the') + 3) ELSE text END AS shown FROM benchmark")
def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-17, TXT-20."""
    rows = _read(spark, sf_dir, "benchmark")
    return rows.select("item_id", T.escape_non_ascii(F.col("text")).alias("escaped"), T.wrap_first(F.col("text"), F.lit("the"), "<b>", "</b>").alias("shown"))


@query(f"SELECT w AS word, CASE WHEN regexp_matches(w, '(a|oasa|easca|ica|ita|ata|uta)$') THEN 'f' WHEN regexp_matches(w, '(os|esc|ic|it|at|ut|iu)$') THEN 'm' WHEN NOT regexp_matches(w, '[aeiou]$') THEN 'm' END AS gender, count(*) AS n FROM {_WORDS} GROUP BY 1, 2")
def word_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-07."""
    words = _folded(spark, sf_dir).select(F.explode(F.filter(F.split("text", " "), lambda w: w != "")).alias("word"))
    return corpus.counts(words, "word").select("word", T.infer_gender(F.col("word")).alias("gender"), "n")  # a word's gender is worked out once


@query("SELECT event_id, try_cast(nullif(regexp_extract(props, '[0-3]'), '') AS INT) AS score FROM events")
def parsed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-29."""
    return _read(spark, sf_dir, "events").select("event_id", T.parse_score(F.col("props")).alias("score"))


@query("SELECT item_id, CASE WHEN length(text) > 120 THEN (CASE WHEN l > 0 THEN '...' ELSE '' END) || substr(text, l + 1, 120) || (CASE WHEN l + 120 < length(text) THEN '...' ELSE '' END) ELSE text END AS cut FROM (SELECT *, greatest(0, least(greatest(strpos(lower(text), 'and'), 1) - 1 + 1 - 60, length(text) - 120)) l FROM benchmark)")
def centred_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-23."""
    return _read(spark, sf_dir, "benchmark").select("item_id", T.centred(F.col("text"), F.lit("and"), 120).alias("cut"))


# --- Filters

_RULES_SQL = "CASE WHEN s < 0.8 THEN 'low_language_score' WHEN length(text) < 100 THEN 'too_short' WHEN length(text) > 20000 THEN 'too_long' WHEN NOT (contains(lower(text), 'the and') OR contains(lower(text), 'of the') OR contains(lower(text), 'de la')) THEN 'no_trigger' ELSE 'passed' END"
_LENGTH_FIRST_SQL = "CASE WHEN length(text) < 100 THEN 'too_short' WHEN length(text) > 20000 THEN 'too_long' WHEN s < 0.8 THEN 'low_language_score' WHEN NOT (contains(lower(text), 'the and') OR contains(lower(text), 'of the') OR contains(lower(text), 'de la')) THEN 'no_trigger' ELSE 'passed' END"
_SCORED_SQL = "(SELECT *, CASE WHEN doc_id % 7 = 0 THEN 0.5 ELSE 0.9 END s FROM documents)"


def _rules(length_first: bool = False):
    score = F.when(F.col("doc_id") % 7 == 0, 0.5).otherwise(0.9)
    return corpus.crawl_rules(F.col("text"), score, 0.8, 100, 20_000, ("the and", "of the", "de la"), length_first)


@query(f"SELECT {_RULES_SQL} AS reason, count(*) AS n FROM {_SCORED_SQL} GROUP BY 1")
def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01 to FLT-04, AGG-23."""
    return corpus.reasons(_read(spark, sf_dir, "documents"), _rules())


@query(f"SELECT lang, {_LENGTH_FIRST_SQL} AS reason, count(*) AS n FROM {_SCORED_SQL} GROUP BY ALL")
def filter_reasons_length_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05."""
    return corpus.reasons(_read(spark, sf_dir, "documents"), _rules(True), "lang")


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality >= 1 AND d.source IN ('src0', 'src1', 'src2')")
def thresholded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07, FLT-12."""
    rows = _read(spark, sf_dir, "documents").filter(F.col("source").isin("src0", "src1", "src2")).join(_read(spark, sf_dir, "labels"), "doc_id")
    return corpus.thresholded(rows, "quality", 1).select("doc_id", "source", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def still_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16, STR-07."""
    return corpus.pending(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0 AND source IN (SELECT source FROM documents WHERE doc_id % 3 = 1 AND n_chars > 3000) AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 1 AND n_chars > 3000)")
def restricted_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10: a third of the documents plays the test rows, the long ones of another third the training rows; the rest plays no part."""
    docs = _read(spark, sf_dir, "documents").withColumn("key", F.md5(F.col("text").cast("binary")))
    return corpus.restricted(docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 = 1 AND n_chars > 3000"), "source", "key").select("doc_id", "source")


@query("SELECT d.doc_id, b.t IS NULL AS is_novel FROM documents d LEFT JOIN (SELECT DISTINCT text t FROM documents WHERE doc_id % 2 = 1) b ON d.text = b.t WHERE d.doc_id % 2 = 0")
def novel_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-17, JOIN-18."""
    docs = _read(spark, sf_dir, "documents")
    return corpus.novel(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), ["text"]).select("doc_id", "is_novel")


# --- Patterns and mining


_PAIR_VERBS = ("the", "of", "is")
_GENDERED = tuple((w, "f" if w in NOUNS else "m") for w in SEEDS)
_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{v}' AS verb, unnest(regexp_extract_all({_FOLD}, '{shape}', 2)) x, unnest(regexp_extract_all({_FOLD}, '{shape}', 3)) y FROM documents"
    for v in _PAIR_VERBS
    for shape in [rf"(?:^|[^a-z])(?:nu\s+)?({v})\s+({patterns.alternation(list(SEEDS))})\s*,?\s*(?:and|,)\s+([a-z]+)"]
)
_GENDER_SQL = "CASE WHEN regexp_matches(y, '(a|oasa|easca|ica|ita|ata|uta)$') THEN 'f' WHEN regexp_matches(y, '(os|esc|ic|it|at|ut|iu)$') THEN 'm' WHEN NOT regexp_matches(y, '[aeiou]$') THEN 'm' END"


@query(f"""WITH p AS ({_PAIRS_SQL}), g AS (SELECT * FROM (VALUES {", ".join(str(x) for x in _GENDERED)}) t(x, gender)),
e AS (SELECT y, list_sort(list(DISTINCT x)) co, list_sort(list(DISTINCT verb)) verbs, list_sort(list(DISTINCT g.gender)) genders, count(*) n, {_GENDER_SQL} gender FROM p JOIN g USING (x) GROUP BY y)
SELECT y AS word, array_to_string(co, ',') AS co_seeds, array_to_string(verbs, ',') AS verbs, array_to_string(genders, ',') AS genders, n, gender,
CASE WHEN length(y) < 3 THEN 'too_short' WHEN y IN ({_in(SEEDS)}) THEN 'already_in_seed' WHEN gender IS NOT NULL AND NOT list_contains(genders, gender) THEN 'gender_mismatch' WHEN y IN ({_in(STOP)}) THEN 'stopword' WHEN len(co) < 2 THEN 'low_co_occurrence' ELSE 'passed' END AS reason,
least(0.4::DOUBLE * least(len(co) / 5, 1.0::DOUBLE) + 0.3::DOUBLE * least(len(verbs) / 3, 1.0::DOUBLE) + 0.3::DOUBLE * least(n / 5, 1.0::DOUBLE) + CASE WHEN list_contains(verbs, 'of') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) AS confidence FROM e""")
def conjunction_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-09, PAT-10, AGG-05, AGG-08, AGG-09, JOIN-05, FLT-15, LEX-03: what is coordinated with known words, validated by the cascade."""
    seeds = spark.createDataFrame([(w, g, ["known"]) for w, g in _GENDERED], "word string, gender string, emotions array<string>")
    pairs = patterns.conjunction_pairs(_folded(spark, sf_dir), list(SEEDS), verbs=_PAIR_VERBS, conjunctions="and", modifier="", word="[a-z]+")
    checked = mining.validate(mining.conjunction_evidence(pairs, seeds), seeds, mining.stopword_table(spark, STOP), primary=("of",))
    return checked.select("word", *[F.array_join(c, ",").alias(c) for c in ("co_seeds", "verbs", "genders")], "n", "gender", "reason", "confidence")


_MATCH_SQL = "\nUNION ALL ".join(
    f"SELECT doc_id, '{t.name}' AS pattern, w AS seed FROM {_WORDS} WHERE {cond} AND w IN ({_in(NOUNS if t.noun_only else SEEDS)})"
    for t, cond in zip(FRAMES, ("p1 = 'the'", "p1 = 'of'", "p1 = 'to'", "p1 = 'in'", "p2 = 'of' AND p1 = 'the'"), strict=True)
)


@query(f"SELECT doc_id, pattern, seed, count(*) AS n FROM ({_MATCH_SQL}) GROUP BY ALL")
def pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-03, PAT-04, JOIN-04: own templates over a lexicon."""
    found = patterns.find_matches(_folded(spark, sf_dir), _lexicon(spark), templates=FRAMES, most=None, modifier="")
    return corpus.counts(found, "doc_id", "pattern", "seed")


@query(f"SELECT pattern, count(*) AS n, count(DISTINCT seed) AS seeds FROM ({_MATCH_SQL}) GROUP BY ALL")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-03, AGG-01, AGG-05."""
    found = patterns.find_matches(_folded(spark, sf_dir), _lexicon(spark), templates=FRAMES, most=None, modifier="")
    return found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seed").alias("seeds"))


_FRAMED_SQL = " UNION ALL ".join(f"SELECT unnest(regexp_extract_all({_FOLD}, '(?:^| ){f} ([a-z]+)', 1)) w, '{f}' f FROM documents" for f in ("the", "of"))


@query(f"SELECT w AS word, count(*) AS frequency, list_sort(list(DISTINCT f)) AS frames FROM ({_FRAMED_SQL}) WHERE length(w) BETWEEN 3 AND 20 AND w NOT IN ({_in(STOP)}) GROUP BY w HAVING count(*) >= 3")
def discovered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-11, PAT-12, FLT-08, FLT-09, JOIN-11, LEX-04."""
    stop = spark.createDataFrame([(w,) for w in STOP], "word string")
    found = patterns.discover(_folded(spark, sf_dir), frames=(("the", "the "), ("of", "of ")))
    return mining.discovered(found, stop).select("word", "frequency", "frames")


@query(f"SELECT pattern AS pattern_used, count(*) AS ok, 0 AS failed, count(*) AS masked FROM ({_MATCH_SQL}) GROUP BY pattern")
def verified_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-14, TXT-27: matches matched again by their own template and masked. Equal ones of a document are verified once and count as often as they are."""
    checked = patterns.verify_spans(patterns.distinct_matches(_folded(spark, sf_dir), _lexicon(spark), templates=FRAMES, modifier=""), FRAMES, "")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return checked.groupBy("pattern_used").agg(total(F.col("verified")).alias("ok"), total(~F.col("verified")).alias("failed"), total(F.contains("masked_text", F.lit(T.MASK))).alias("masked"))


# Sentences of which the templates' matches are known: (text, then pattern, start, end, start and text of the seed of each match).
GOLDEN = (
    ("Mă simt fericit astăzi.", (("ma_simt_present", 0, 15, 8, "fericit"),)),
    ("M-am simțit foarte bine la petrecere.", (("mam_simtit_perfect", 0, 23, 19, "bine"),)),
    ("O să mă simt mai bine mâine.", (("ma_simt_present", 5, 21, 17, "bine"), ("o_sa_ma_simt_future", 0, 21, 17, "bine"), ("sa_ma_simt_subjunctive", 2, 21, 17, "bine"))),
    ("O să fiu trist fără tine.", (("o_sa_fiu_future", 0, 14, 9, "trist"),)),
    ("M-aș simți mai relaxat acasă.", (("mas_simti_conditional", 0, 22, 15, "relaxat"),)),
    ("Vreau să mă simt calm.", (("ma_simt_present", 9, 21, 17, "calm"), ("sa_ma_simt_subjunctive", 6, 21, 17, "calm"), ("simt_noun", 12, 21, 17, "calm"))),
    ("Mă fac fericit când aud muzică.", (("ma_fac_reflexive", 0, 14, 7, "fericit"),)),
    ("Mi-e frică de câini.", (("mie_short", 0, 10, 5, "frica"),)),
    ("Îmi este teamă; aveam încredere.", (("imi_este_present", 0, 14, 9, "teama"), ("aveam_noun_imperfect", 16, 31, 22, "incredere"))),
    ("Sunt fericită și eram tristă.", (("sunt_adj_present", 0, 13, 5, "fericita"), ("eram_adj_imperfect", 17, 28, 22, "trista"))),
)
_GOLDEN_ROWS = ", ".join(f"({i}, '{p}', {a}, {b}, {c}, '{w}')" for i, (_, found) in enumerate(GOLDEN) for p, a, b, c, w in found)
STATES = (("fericit", "joy", "adjective"), ("trist", "sadness", "adjective"), ("bine", "joy", "adverb"), ("relaxat", "trust", "adjective"), ("calm", "trust", "adjective"), ("frică", "fear", "noun"), ("teamă", "fear", "noun"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and names of customer, dealt in small pieces, as each short row becomes a sentence that all templates work on."""
    return readers.spread(_read(spark, sf_dir, "customer").select("c_custkey", "c_name"), readers.SHORT_BYTES)


def _states(spark: SparkSession) -> DataFrame:
    """A lexicon expanded to word forms, with the nouns that only noun templates take."""
    words = spark.createDataFrame([(w, p, [e]) for w, e, p in STATES], "word string, pos string, emotions array<string>")
    return patterns.with_nouns(lexicon.expand(words, spark.createDataFrame([("tristă", "trist", "Afpfsrn")], "form string, lemma string, msd string")))


@query(f"SELECT c_custkey AS custkey, p AS pattern, a + length(c_name) + 2 AS start, b + length(c_name) + 2 AS \"end\", s + length(c_name) + 2 AS seed_start, w AS seed FROM customer JOIN (VALUES {_GOLDEN_ROWS}) g(i, p, a, b, s, w) ON c_custkey % {len(GOLDEN)} = i")
def golden_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-01, PAT-02, PAT-04, PAT-05, PAT-06, PAT-07: all templates, intensifiers, an expanded lexicon and the noun table, on sentences after a customer's name."""
    texts = F.array(*[F.lit(t) for t, _ in GOLDEN])
    rows = _customers(spark, sf_dir).select(F.col("c_custkey").alias("custkey"), F.concat("c_name", F.lit(": "), F.get(texts, (F.col("c_custkey") % len(GOLDEN)).cast("int"))).alias("text"))
    return patterns.find_matches(rows, _states(spark)).select("custkey", "pattern", "start", "end", "seed_start", "seed")


@query(f"SELECT c_custkey % {len(GOLDEN)} AS kind, count(*) AS n, min(arg) AS pattern FROM (SELECT c_custkey, arg_min(p, i2) AS arg FROM customer JOIN (SELECT *, row_number() OVER () i2 FROM (VALUES {_GOLDEN_ROWS}) g(i, p, a, b, s, w)) ON c_custkey % {len(GOLDEN)} = i GROUP BY c_custkey) GROUP BY 1")
def golden_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-04, PAT-05, TXT-05: of a sentence only the earliest template's match stays."""
    texts = F.array(*[F.lit(t.replace("; ", " ").replace(" și eram", " și nu")) for t, _ in GOLDEN])
    rows = _customers(spark, sf_dir).select((F.col("c_custkey") % len(GOLDEN)).alias("kind"), F.concat("c_name", F.lit(". "), F.get(texts, (F.col("c_custkey") % len(GOLDEN)).cast("int"))).alias("text"))
    return patterns.candidates(rows, _states(spark)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("pattern").alias("pattern"))


@query(f"SELECT 'pair' AS kind, y AS word, count(*) AS n FROM ({_PAIRS_SQL}) GROUP BY y UNION ALL SELECT 'frame', w, count(*) FROM (SELECT unnest(regexp_extract_all({_FOLD}, '(?:^| )of ([a-z]+)', 1)) w FROM documents) GROUP BY w")
def mined_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-13: pairs and framed words from one reading of the texts."""
    found = patterns.mined(_folded(spark, sf_dir), list(SEEDS), frames=(("of", "of "),), verbs=_PAIR_VERBS, conjunctions="and", modifier="", word="[a-z]+")
    return corpus.counts(found.select(F.when(F.col("y").isNotNull(), "pair").otherwise("frame").alias("kind"), F.coalesce("y", "word").alias("word")), "kind", "word")


@query()
def bootstrapped_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ITR-01, ITR-02, LEX-02, LEX-03, AGG-09, AGG-10: four rounds, or fewer if one adds no word."""
    seeds = spark.createDataFrame([(w, "m", ["known"]) for w in SEEDS], "word string, gender string, emotions array<string>")
    stop = spark.createDataFrame([(w,) for w in STOP], "word string")
    found, _ = mining.bootstrap(_folded(spark, sf_dir), seeds, stop, verbs=("the", "of", "is"), conjunctions="and|of", modifier="", word="[a-z]+")
    return found.select("word", "gender", F.array_join("emotions", ",").alias("emotions"))


# --- Lexicons


@query("SELECT coalesce(a.word, b.word) AS word, CASE WHEN a.word IS NOT NULL AND b.word IS NOT NULL THEN least(0.5::DOUBLE + 0.2::DOUBLE, 1.0::DOUBLE) WHEN a.word IS NOT NULL THEN 0.5::DOUBLE ELSE round(least(b.frequency / 10, 0.8::DOUBLE), 3) END AS confidence, CASE WHEN a.word IS NULL THEN 'distributional' WHEN b.word IS NULL THEN 'bootstrapping' ELSE 'bootstrapping,distributional' END AS methods, CASE WHEN a.word IS NULL THEN 'discovered' WHEN b.word IS NULL THEN 'joy' ELSE 'joy,trust' END AS emotions, a.gender FROM (SELECT DISTINCT lower(p_brand) word, 'm' gender FROM part WHERE p_size < 10) a FULL JOIN (SELECT lower(p_brand) word, count(*) frequency FROM part WHERE p_size > 45 GROUP BY 1) b ON a.word = b.word WHERE coalesce(a.word, b.word) NOT IN ('brand#11', 'brand#22')")
def merged_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-13, ARR-03: words of two methods, without those of the seed."""
    part = _read(spark, sf_dir, "part")
    one = part.filter("p_size < 10").select(F.lower("p_brand").alias("word")).distinct().select("word", F.lit(None).cast("double").alias("confidence"), F.array(F.lit("joy")).alias("emotions"), F.lit("m").alias("gender"))
    two = part.filter("p_size > 45").groupBy(F.lower("p_brand").alias("word")).agg(F.count(F.lit(1)).alias("frequency"))
    also = one.select("word").join(two.select("word"), "word", "left_semi").withColumn("emotions", F.array(F.lit("joy"), F.lit("trust")))
    seeds = spark.createDataFrame([("Brand#11",), ("BRAND#22",)], "word string")
    merged = lexicon.merge_discoveries(one, two.join(also, "word", "left"), seeds)
    return merged.select("word", "confidence", F.array_join("methods", ",").alias("methods"), F.array_join("emotions", ",").alias("emotions"), "gender")


@query("SELECT s.id, coalesce(s.category, n.category) AS category FROM (SELECT n_nationkey AS id, n_regionkey AS noun_id, CASE WHEN n_nationkey < 5 THEN n_name END AS category FROM nation) s LEFT JOIN (SELECT n_nationkey AS id, n_name AS category FROM nation WHERE n_nationkey < 5) n ON s.noun_id = n.id WHERE coalesce(s.category, n.category) IS NOT NULL")
def inherited_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-02: rows without a category take that of the row they name."""
    rows = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("noun_id"), F.when(F.col("n_nationkey") < 5, F.col("n_name")).alias("category"))
    return lexicon.inherit_category(rows).select("id", "category")


@query("SELECT word, kind FROM (SELECT word, kind, row_number() OVER (PARTITION BY word ORDER BY prio) rn FROM (SELECT DISTINCT lower(p_brand) word, 'small' kind, 0 prio FROM part WHERE p_size < 5 UNION ALL SELECT DISTINCT lower(p_brand), 'middle', 1 FROM part WHERE p_size < 25 UNION ALL SELECT DISTINCT lower(p_brand), 'all', 2 FROM part)) WHERE rn = 1")
def priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01."""
    part = _read(spark, sf_dir, "part")
    some = lambda c, kind: part.filter(c).select(F.lower("p_brand").alias("word")).distinct().withColumn("kind", F.lit(kind))
    return lexicon.union_by_priority([some("p_size < 5", "small"), some("p_size < 25", "middle"), some("true", "all")]).select("word", "kind")


@query("SELECT n_regionkey % 2 AS pos, n_nationkey % 7 AS off30, arg_max(n_name, n_nationkey) AS category FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 4 GROUP BY 1, 2")
def mapped_synsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-01: an inner join that keeps the last category of a target."""
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    synsets = nation.select((F.col("n_regionkey") % 2).alias("pos"), F.struct(F.col("n_regionkey").cast("bigint").alias("r"), (F.col("n_nationkey") % 7).cast("bigint").alias("x")).alias("off16"), F.col("n_name").alias("category"), F.col("n_nationkey").alias("ord"))
    mapping = region.filter("r_regionkey < 4").join(spark.range(7).select(F.col("id").alias("off30"))).select((F.col("r_regionkey") % 2).alias("pos"), F.struct(F.col("r_regionkey").cast("bigint").alias("r"), F.col("off30").alias("x")).alias("off16"), "off30")
    return lexicon.map_synsets(synsets, mapping)[0]


@query("WITH RECURSIVE e AS (SELECT n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region), up AS (SELECT name, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT u.name, e.parent, u.depth + 1 FROM up u JOIN e ON u.ancestor = e.name) SELECT * FROM up")
def taxonomy_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomy tree."""
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    edges = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent")).unionByName(region.select(F.col("r_name").alias("name"), F.lit("WORLD").alias("parent")))
    return lexicon.ancestors(edges, f"taxonomy_{uuid.uuid4().hex}")


# --- Deduplication and sets


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) rn FROM documents) WHERE rn = 1")
def exact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-01, DED-02, WIN-01."""
    return corpus.first_by(_read(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("key")), ["key"], ["source", "doc_id"]).select("doc_id", "source")


@query("SELECT lang, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY md5(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, doc_id) rn FROM documents) WHERE rn = 1 GROUP BY lang")
def priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-06, SET-02, SET-06."""
    docs = _read(spark, sf_dir, "documents")
    parts = [docs.filter("lang = 'en'"), docs.filter("lang = 'fr'"), docs.filter("lang NOT IN ('en', 'fr')")]
    return corpus.counts(corpus.unify(parts, "doc_id", "text"), "lang")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) rn FROM conversations) WHERE rn = 1")
def first_in_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-03, DED-05, DED-07, DED-08."""
    return corpus.first_by(_read(spark, sf_dir, "conversations"), ["conv_id", "text"], ["turn"]).select("conv_id", "turn")


@query("SELECT page_id FROM (SELECT *, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]+)', 1), md5(html) ORDER BY page_id) rn FROM pages) WHERE rn = 1")
def boilerplate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-04."""
    pages = _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.md5(F.col("html").cast("binary")).alias("key"))
    return corpus.first_by(pages, ["host", "key"], ["page_id"]).select("page_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-09."""
    return corpus.last_by(_read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT 'intersect' AS op, count(*) AS n FROM (SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE n_chars > 10000) UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03, SET-04, SET-05."""
    docs = _read(spark, sf_dir, "documents")
    both = corpus.in_both(docs.filter("lang = 'en'"), docs.filter("n_chars > 10000"), "source")
    rest = corpus.only_in(docs, _read(spark, sf_dir, "labels"), "doc_id")
    count = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return count(both, "intersect").unionByName(count(rest, "except"))


# --- Aggregation


@query("SELECT 'lang' AS dimension, lang AS key, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'all', NULL, count(*) FROM documents")
def grouping_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03."""
    return corpus.counts_by_each(_read(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT 'lang' AS dimension, lang AS key, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'all', 'all', count(*) FROM documents")
def written_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03: counts as one JSON object, written and read again."""
    path = f"{scratch(spark)}/stats-{uuid.uuid4().hex}"
    sinks.stats(corpus.counts_by_each(_read(spark, sf_dir, "documents"), "lang", "source"), path)
    maps = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,map<string,bigint>>")).alias("dimension", "m"))
    return maps.select("dimension", F.explode("m").alias("key", "n"))


@query("SELECT source, count(*) FILTER (WHERE quality = 0) AS n_0, count(*) FILTER (WHERE quality = 1) AS n_1 FROM documents JOIN labels USING (doc_id) GROUP BY source")
def score_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, AGG-17, JOIN-08."""
    return corpus.crosstab(_read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id"), "source", "quality", [0, 1])


@query("SELECT lang, avg((quality >= 1)::INT) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def affect_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06, AGG-19."""
    return corpus.rate(_read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id"), F.col("quality") >= 1, "lang")


@query("SELECT w AS value, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) w FROM conversations) GROUP BY w ORDER BY n DESC, w LIMIT 50")
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02, SRT-01, SRT-02."""
    rows = corpus.exploded_counts(_read(spark, sf_dir, "conversations").select(F.split("text", " ").alias("ws")), "ws")
    return corpus.top(rows, 50, F.desc("n"), "value")


@query("SELECT lang, min(n_chars) AS least, max(n_chars) AS most, avg(n_chars) AS mean, max(n_chars) FILTER (WHERE i = c // 2 + 1) AS median FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars) i, count(*) OVER (PARTITION BY lang) c FROM documents) GROUP BY lang")
def length_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, AGG-20."""
    return corpus.upper_median(_read(spark, sf_dir, "documents").select("lang", "n_chars"), "n_chars", "lang")


@query("SELECT round_even(avg(n_chars), 0) AS n_chars, round_even(avg(doc_id), 0) AS doc_id FROM documents")
def rounded_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07: means rounded half to even."""
    return corpus.rounded_means(_read(spark, sf_dir, "documents"), "n_chars", "doc_id")


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE len(regexp_extract_all(text, 'the')) > 1) AS several FROM documents GROUP BY lang")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-32: rows by language, and those with more than one mask (here: the)."""
    return corpus.language_counts(_read(spark, sf_dir, "documents"), "text", "lang", mask="the")


@query("SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id)")
def joined_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-14, JOIN-15: results joined to their items, in the items' order."""
    return corpus.in_order(_read(spark, sf_dir, "labels").select("doc_id", "quality"), _read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "doc_id").select("doc_id", "n_chars", "quality")


@query("SELECT quantile_cont(n_chars, 0.05) AS p5, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.95) AS p95, count(*) FILTER (WHERE n_chars >= 100) AS n_0, count(*) FILTER (WHERE n_chars >= 1000) AS n_1, count(*) FILTER (WHERE n_chars >= 10000) AS n_2 FROM documents")
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21."""
    return corpus.length_profile(_read(spark, sf_dir, "documents"), "n_chars", [100, 1000, 10000])


@query("SELECT max(k) AS most, quantile_cont(k, 0.5) AS median, avg(k) AS mean, count(*) FILTER (WHERE k = 1) AS single, count(*) FILTER (WHERE k >= 2) AS several FROM (SELECT user_id, count(*) k FROM events WHERE value > 50 GROUP BY user_id)")
def hits_per_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22."""
    return corpus.hit_profile(_read(spark, sf_dir, "events").filter("value > 50"), "user_id")


@query("SELECT event_type, count(*) AS n, sum(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS total FROM events GROUP BY event_type")
def event_json_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-01, JSN-03."""
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(T.json_number(F.col("props"), "k")).alias("total"))


# --- Metrics

_PREDICTIONS_SQL = "(SELECT conv_id, turn, role, ws[1:5] AS p, ws[3] AS g FROM (SELECT *, string_split(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' ') ws FROM conversations))"


@query(f"SELECT role, count(*) AS n, avg(coalesce(list_contains(p[1:1], g), false)::INT) AS acc_at_1, avg(coalesce(list_contains(p[1:3], g), false)::INT) AS acc_at_3, avg(coalesce(list_contains(p[1:5], g), false)::INT) AS acc_at_5, avg(coalesce(1.0::DOUBLE / nullif(list_position(p, g), 0), 0)) AS mrr FROM {_PREDICTIONS_SQL} GROUP BY role")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11, AGG-12, WIN-09, ARR-01."""
    ws = F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " ")
    rows = _read(spark, sf_dir, "conversations").select("role", F.slice(ws, 1, 5).alias("p"), F.get(ws, F.lit(2)).alias("g"))
    return metrics.ranking(rows, "p", "g", "role")


_PAIR_SQL = "SELECT quality a, toxic b FROM labels"


@query("WITH r AS (SELECT quality a, toxic b FROM labels), s AS (SELECT count(*) n, sum((a = b)::INT) same, sum(a) a1, sum(b) b1 FROM r) SELECT n, same / n AS agreement, 1 - (n - same)::DOUBLE * n / (a1 * (n - b1) + (n - a1) * b1) AS kappa FROM s")
def rater_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15, AGG-16."""
    return metrics.kappa(_read(spark, sf_dir, "labels"), "quality", "toxic")


@query("WITH r AS (SELECT least(n_chars // 3000, 3) a, least(doc_id % 5, 3) b FROM documents), o AS (SELECT count(*) n, sum((a = b)::INT) same, sum((a - b) * (a - b)) seen FROM r), e AS (SELECT sum(x.c * y.c * (a - b) * (a - b)) chance FROM (SELECT a, count(*) c FROM r GROUP BY a) x, (SELECT b, count(*) c FROM r GROUP BY b) y) SELECT n, same / n AS agreement, 1 - seen::DOUBLE * n / chance AS kappa FROM o, e")
def quadratic_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16 with quadratic weights."""
    rows = _read(spark, sf_dir, "documents").select(F.least(F.expr("n_chars div 3000"), F.lit(3)).alias("a"), F.least(F.col("doc_id") % 5, F.lit(3)).alias("b"))
    return metrics.kappa(rows, "a", "b", "quadratic")


@query("SELECT quality, count(*) FILTER (WHERE toxic = 0) AS b_0, count(*) FILTER (WHERE toxic = 1) AS b_1 FROM labels GROUP BY quality UNION ALL SELECT v, 0, 0 FROM (VALUES (0), (1)) t(v) WHERE v NOT IN (SELECT quality FROM labels)")
def rater_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17."""
    return metrics.confusion(_read(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


@query("WITH r AS (SELECT n_chars a, quality b FROM documents JOIN labels USING (doc_id)), k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 rb FROM r) SELECT count(*) AS n, corr(ra, rb) AS rho FROM k")
def spearman_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18, WIN-02."""
    return metrics.spearman(_read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id"), "n_chars", "quality").drop("p")


@query("WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) tn, avg(abs(quality - toxic)) mae FROM labels) SELECT tp, fp, fn, tn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy, (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 AS macro_f1, mae FROM c")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25."""
    return metrics.binary_scores(_read(spark, sf_dir, "labels"), "quality", "toxic")


@query("WITH v AS (SELECT [(l_quantity > 25)::INT, (l_discount > 0.05)::INT, (l_tax > 0.04)::INT] g, [(l_quantity > 30)::INT, (l_discount > 0.03)::INT, (l_tax > 0.04)::INT] p FROM lineitem), s AS (SELECT count(*) n, sum((g[1] = p[1])::INT + (g[2] = p[2])::INT + (g[3] = p[3])::INT) same, sum((g = p)::INT) exact, sum(g[1] * p[1] + g[2] * p[2] + g[3] * p[3]) tp, sum(list_sum(g) + list_sum(p)) ones FROM v) SELECT n, 1 - same / (3 * n) AS hamming, exact / n AS subset_accuracy, 2 * tp / ones AS micro_f1, (3 * n - same) / (3 * n) AS mse FROM s")
def multilabel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-26."""
    bit = lambda c: F.expr(f"cast({c} AS int)")
    rows = _read(spark, sf_dir, "lineitem").select(F.array(bit("l_quantity > 25"), bit("l_discount > 0.05"), bit("l_tax > 0.04")).alias("g"), F.array(bit("l_quantity > 30"), bit("l_discount > 0.03"), bit("l_tax > 0.04")).alias("p"))
    return metrics.multilabel_scores(rows, "g", "p")


@query(" UNION ALL ".join(f"SELECT '{n}' AS label, tp, fp, fn, tn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM (SELECT count(*) FILTER (WHERE {g} AND {p}) tp, count(*) FILTER (WHERE NOT {g} AND {p}) fp, count(*) FILTER (WHERE {g} AND NOT {p}) fn, count(*) FILTER (WHERE NOT {g} AND NOT {p}) tn FROM lineitem)" for n, g, p in (("quantity", "l_quantity > 25", "l_quantity > 30"), ("discount", "l_discount > 0.05", "l_discount > 0.03"))))
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-26 by label."""
    bit = lambda c: F.expr(f"cast({c} AS int)")
    rows = _read(spark, sf_dir, "lineitem").select(F.array(bit("l_quantity > 25"), bit("l_discount > 0.05")).alias("g"), F.array(bit("l_quantity > 30"), bit("l_discount > 0.03")).alias("p"))
    return metrics.per_label_scores(rows, "g", "p", ["quantity", "discount"]).drop("macro_f1", "mae")


@query(r"WITH w AS (SELECT conv_id, turn, regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\s]', '', 'g'), '\s+') ws FROM conversations), t AS (SELECT *, list_filter(ws, lambda x: x <> '') ts FROM w) SELECT conv_id, turn, list_contains(ts, 'the') AS one, list_contains(list_transform(list_zip(ts[:-2], ts[2:]), lambda z: z[1] || ' ' || z[2]), 'of the') AS two FROM t")
def held_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: labels as runs of whole words."""
    rows = _read(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace(F.lower("text"), r"[^a-z0-9_\s]", ""))
    return rows.select("conv_id", "turn", metrics.holds_label(F.col("text"), F.lit("The!")).alias("one"), metrics.holds_label(F.col("text"), F.lit("of the")).alias("two"))


@query("SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM (SELECT threshold, count(*) FILTER (WHERE quality = 1 AND n_chars >= threshold) tp, count(*) FILTER (WHERE quality = 0 AND n_chars >= threshold) fp, count(*) FILTER (WHERE quality = 1 AND n_chars < threshold) fn FROM documents JOIN labels USING (doc_id), (SELECT unnest([100, 1000, 5000]) threshold) GROUP BY threshold)")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-27."""
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")
    return metrics.threshold_sweep(rows, F.col("quality") == 1, "n_chars", [100, 1000, 5000])


@query("WITH f AS (SELECT o_custkey, count(*) f FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), t AS (SELECT coalesce(f, 0) f, (o_totalprice > 150000)::INT ok FROM orders LEFT JOIN f USING (o_custkey) WHERE o_orderkey % 2 = 1) SELECT at_least, count(*) AS n, avg(ok) AS accuracy FROM t, (SELECT unnest([1, 5, 10]) at_least) WHERE f >= at_least GROUP BY at_least")
def accuracy_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-33."""
    orders = _read(spark, sf_dir, "orders")
    test = orders.filter("o_orderkey % 2 = 1").withColumn("ok", F.col("o_totalprice") > 150000)
    return metrics.accuracy_by_frequency(test, orders.filter("o_orderkey % 2 = 0"), "o_custkey", "ok", [1, 5, 10])


# --- Windows, samples, splits


@query("SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ',') AS before, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ',') AS after FROM conversations")
def turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07."""
    rows = corpus.neighbours(_read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")
    shown = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)
    return rows.select("conv_id", "turn", shown("before"), shown("after"))


@query("WITH m AS (SELECT *, min(CASE WHEN turn >= 2 AND role = 'user' THEN turn END) OVER (PARTITION BY conv_id) a, CASE WHEN role = 'assistant' THEN turn END b FROM conversations), k AS (SELECT *, max(b) FILTER (WHERE b < a) OVER (PARTITION BY conv_id) lo, min(b) FILTER (WHERE b > a) OVER (PARTITION BY conv_id) hi FROM m) SELECT conv_id, turn FROM k WHERE a IS NOT NULL AND (lo IS NULL OR turn > lo) AND (hi IS NULL OR turn < hi)")
def turn_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06."""
    rows = _read(spark, sf_dir, "conversations")
    return corpus.islands(rows, ["conv_id"], "turn", F.col("role") == "assistant", (F.col("turn") >= 2) & (F.col("role") == "user")).select("conv_id", "turn")


@query("WITH m AS (SELECT *, min(CASE WHEN turn >= 2 AND role = 'user' THEN turn END) OVER (PARTITION BY conv_id) a, CASE WHEN role = 'assistant' THEN turn END b FROM conversations), k AS (SELECT *, max(b) FILTER (WHERE b < a) OVER (PARTITION BY conv_id) lo, min(b) FILTER (WHERE b > a) OVER (PARTITION BY conv_id) hi FROM m) SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM k WHERE a IS NOT NULL AND (lo IS NULL OR turn > lo) AND (hi IS NULL OR turn < hi) GROUP BY conv_id")
def first_person_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-16: the run of first-person parts around an anchor; the other role plays the second person."""
    turns = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    at = F.array_position(F.transform("t", lambda x: (x["turn"] >= 2) & (x["role"] == "user")), True)
    parts, who = F.transform("t", lambda x: x["text"]), F.transform("t", lambda x: F.when(x["role"] == "assistant", 2).otherwise(1))
    return turns.withColumn("at", at).filter("at > 0").select("conv_id", T.first_person_run(parts, who, F.col("at")).alias("text"))


_WORDS_OF = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_ENDED = f"array_to_string(list_transform({_WORDS_OF}, lambda w, i: CASE WHEN regexp_matches(w, '^\\p{{Ll}}') AND NOT regexp_matches(w, '[.?!]$') AND rtrim(lower(w), '.,!?') NOT IN ({_in(T.NO_SPLIT_AFTER)}) AND coalesce(regexp_matches({_WORDS_OF}[i + 1], '^\\p{{Lu}}'), false) THEN rtrim(w, '., ') || '.' ELSE w END), ' ')"


@query(f"SELECT item_id, CASE WHEN regexp_matches(e, '[.?!]$') THEN e ELSE e || '.' END AS ended FROM (SELECT item_id, {_ENDED} e FROM benchmark WHERE text <> '')")
def ended_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-13, WIN-04: periods where a capital follows a small word."""
    return _read(spark, sf_dir, "benchmark").filter("text <> ''").select("item_id", T.add_periods(F.col("text")).alias("ended"))


@query("SELECT source, n, coalesce(sum(n) OVER (ORDER BY md5(source || '42'), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < round_even((sum(n) OVER ()) * 0.1::DOUBLE, 0) AS held FROM (SELECT source, count(*) n FROM documents GROUP BY source)")
def group_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-03, WIN-08."""
    return sampling.group_holdout(_read(spark, sf_dir, "documents"), "source")


@query("WITH h AS (SELECT source, coalesce(sum(n) OVER (ORDER BY md5(source || '42'), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < round_even((sum(n) OVER ()) * 0.1::DOUBLE, 0) AS held FROM (SELECT source, count(*) n FROM documents GROUP BY source)), r AS (SELECT d.*, held, row_number() OVER (PARTITION BY held ORDER BY md5(doc_id || '42'), doc_id) i, count(*) OVER () c FROM documents d JOIN h USING (source)) SELECT doc_id, CASE WHEN held THEN 'test' WHEN i <= round_even(c * 0.05::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM r")
def leakage_free_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-03."""
    return sampling.leakage_free_split(_read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "split")


@query("SELECT split, lang, count(*) AS n FROM (SELECT lang, CASE WHEN i <= floor(c * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '42'), doc_id) i, count(*) OVER (PARTITION BY lang) c FROM documents)) GROUP BY ALL")
def written_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-08, SNK-09, PRJ-15: files by split and language, written and read again."""
    path = f"{scratch(spark)}/splits-{uuid.uuid4().hex}"
    sinks.splits(sampling.stratified_split(_read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.9), path, "split", "lang", order=("doc_id",))
    return corpus.counts(spark.read.parquet(path), "split", "lang").select(F.col("split").cast("string").alias("split"), F.col("lang").cast("string").alias("lang"), "n")


@query("SELECT 'documents_' || doc_id AS id, text, 'documents' AS source FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0")
def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01, SRC-02, SNK-01, FLT-06: corpus lines, written and read again; blank texts go."""
    path = f"{scratch(spark)}/lines-{uuid.uuid4().hex}/documents.jsonl"
    sinks.jsonl(_read(spark, sf_dir, "documents").select(F.concat(F.lit("documents_"), "doc_id").alias("id"), "text", F.lit("documents").alias("source")), path)
    return readers.jsonl(spark, path).select("id", "text", "source")


@query("SELECT 'fulg_' || substr(md5(text), 1, 12) AS id, length(text)::INT AS n, lang AS source_domain FROM documents WHERE length(text) >= 200 AND length(text) <= 5000 AND (CASE WHEN doc_id % 7 = 0 THEN 0.5 ELSE 0.9 END) >= 0.8")
def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09, SRC-10: a crawl in corpus form, by language score and length."""
    docs = _read(spark, sf_dir, "documents").select(F.col("text").alias("raw_content"), F.lit("u").alias("url"), F.lit("t").alias("title"), F.col("lang").alias("source_domain"), F.length("text").alias("length"), F.when(F.col("doc_id") % 7 == 0, 0.5).otherwise(0.9).alias("language_score"), F.md5(F.col("text").cast("binary")).alias("digest"))
    return readers.crawl(docs, 0.8, 200, 5000).select("id", F.col("full_text_length").alias("n"), "source_domain")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id * 1000 WHEN event_id % 3 = 1 THEN event_id * 1000000 ELSE event_id END AS views, event_id // 3600 * 3600 + event_id % 3600 AS seconds, 'abcdefghijk' AS video FROM events")
def parsed_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-24, TXT-25, TXT-26: views, durations and ids of videos as sites write them."""
    e, unit = F.col("event_id"), F.get(F.array(F.lit("K"), F.lit("M"), F.lit("")), (F.col("event_id") % 3).cast("int"))
    clock = F.concat_ws(":", F.expr("event_id div 3600").cast("string"), F.lpad((F.expr("event_id div 60") % 60).cast("string"), 2, "0"), F.lpad((e % 60).cast("string"), 2, "0"))
    return _read(spark, sf_dir, "events").select("event_id", T.parse_views(F.concat(e.cast("string"), unit, F.lit(" views"))).alias("views"), T.parse_duration(clock).alias("seconds"), T.video_id(F.concat(F.lit("https://youtu.be/abcdefghijk?t="), e.cast("string"))).alias("video"))


@query("SELECT doc_id, lower(w) AS word, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'Big ' || w ELSE w END AS reply FROM (SELECT doc_id, regexp_extract(text, '[A-Za-z]{4,}') w FROM documents) WHERE w <> ''")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-30: the word of a wordy reply, and its normal form."""
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("w")).filter("w <> ''")
    said = F.concat(F.lit("<think>well</think> **Răspuns:** "), F.col("w"), F.lit(", de ce nu"))
    got = rows.select("doc_id", T.parse_single_word(said).alias("reply"))
    return got.select("doc_id", T.normalize_prediction(F.concat(F.lit(" "), "reply", F.lit("!"))).alias("word"), F.when(F.col("reply").rlike("^[A-Z]"), F.concat(F.lit("Big "), "reply")).otherwise(F.col("reply")).alias("reply"))


_EDGE = r"[^\p{L}\p{M}\p{Nd}_]"


@query(f"SELECT doc_id, regexp_replace(text, '(?i)(^|{_EDGE})the({_EDGE}|$)', '\\1[MASK]\\2') AS masked FROM documents WHERE regexp_matches(text, '(?i)(^|{_EDGE})the({_EDGE}|$)')")
def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-27: the first whole word masked."""
    return _read(spark, sf_dir, "documents").select("doc_id", T.mask_word(F.col("text"), F.lit("the")).alias("masked")).filter("masked IS NOT NULL")


@query("SELECT doc_id, CASE WHEN i <= floor(c * 0.95::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '42'), doc_id) i, count(*) OVER (PARTITION BY source) c FROM documents)")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-02."""
    return sampling.stratified_split(_read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "split")


@query("WITH r AS (SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)), c AS (SELECT quality, lang, count(*) c FROM r GROUP BY ALL), t AS (SELECT *, least(sum(c) OVER q, 50) t, greatest(1, floor(least(sum(c) OVER q, 50) * c / sum(c) OVER q + 0.5)) k FROM c WINDOW q AS (PARTITION BY quality)), u AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY quality ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) taken, row_number() OVER (PARTITION BY quality ORDER BY lang DESC) = 1 last FROM t), v AS (SELECT quality, lang, greatest(0, least(CASE WHEN last THEN t - taken ELSE least(k, t - taken) END, c)) q FROM u), n AS (SELECT *, row_number() OVER (PARTITION BY quality, lang ORDER BY md5(doc_id || '42'), doc_id) i FROM r) SELECT doc_id, n.lang, n.quality FROM n JOIN v ON n.quality = v.quality AND n.lang = v.lang WHERE i <= q")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-01."""
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality")
    return sampling.stratified(rows, "quality", "lang", "doc_id")


@query("SELECT doc_id, CASE WHEN i <= 20 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '42'), doc_id) i FROM documents) WHERE i <= 50")
def quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-04, SRT-06, WIN-03."""
    return sampling.quotas(_read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", [("val", 20), ("test", 30)], by=["lang"]).select("doc_id", "split")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || '7'), doc_id LIMIT 100")
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-07, SMP-05."""
    return sampling.head_sample(_read(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id", 7)


# --- Vectors


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _read(spark, sf_dir, "embeddings")
    return rows.filter("label <> 0"), rows.filter("label = 0")


_NEAREST_SQL = "(SELECT e.vec_id, e.label, arg_max(a.vec_id, (list_inner_product(e.embedding::DOUBLE[], a.embedding::DOUBLE[]), -a.vec_id)) AS anchor, max(list_inner_product(e.embedding::DOUBLE[], a.embedding::DOUBLE[])) AS similarity FROM embeddings e, embeddings a WHERE e.label <> 0 AND a.label = 0 GROUP BY ALL)"


@query(f"SELECT vec_id, anchor, similarity FROM {_NEAREST_SQL}")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-07, VEC-02, WIN-10: the anchors are the query set, held against all rows in blocks."""
    rows, anchors = _vectors(spark, sf_dir)
    return vector.nearest_blocked(rows, anchors, "vec_id", "embedding", "vec_id")


@query("SELECT label, count(*) AS n, min(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS least, max(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS most FROM embeddings GROUP BY label")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-03: lengths of the vectors."""
    return _read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(vector.norm(F.col("embedding"))).alias("least"), F.max(vector.norm(F.col("embedding"))).alias("most"))


_IP = lambda a, b: f"list_inner_product({a}.embedding::DOUBLE[], {b}.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id, greatest({_IP('a', 'b')} / (sqrt({_IP('a', 'a')}) * sqrt({_IP('b', 'b')})), 0.0::DOUBLE) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-03: cosines, negative ones as 0."""
    rows = _read(spark, sf_dir, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    return rows.join(other, "vec_id").select("vec_id", vector.cosine(F.col("embedding"), F.col("w"), clamp=True).alias("similarity"))


@query(f"SELECT label AS post, count(*) AS n, max(round(similarity, 4)) AS best FROM {_NEAREST_SQL} WHERE similarity >= 0.2 AND (anchor % 2 = 0 OR anchor % 10 < 4) AND round(similarity, 4) >= 0.25 GROUP BY label")
def grouped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-04, AGG-24, SRT-03, FLT-10."""
    rows, anchors = _vectors(spark, sf_dir)
    near = vector.nearest_blocked(rows, anchors, "vec_id", "embedding", "vec_id").join(rows.select("vec_id", F.col("label").alias("post")), "vec_id")
    near = near.withColumn("pattern", F.when(F.col("anchor") % 2 == 0, "any").otherwise("noun")).withColumn("phrase", F.concat(F.lit("mi-e n"), (F.col("anchor") % 10).cast("string"), F.lit("!")))
    hits = vector.group_hits(near, "post", "vec_id", "similarity", "phrase", "pattern", least=0.2)
    hits = vector.valid_hits(hits, ["noun"], ["n0", "n1", "n2", "n3"], least=0.25, anchor="phrase", pattern="pattern")
    return hits.select("post", F.size("hits").cast("bigint").alias("n"), F.col("hits")[0]["confidence"].alias("best"))


# --- Small relations


@query("SELECT n_name AS word, n_regionkey % 2 AS pos, r_name AS category FROM nation JOIN region ON n_regionkey % 2 = r_regionkey % 2 AND n_nationkey = r_regionkey * 5")
def affect_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-03: a lexicon joined to categories by part of speech and offset."""
    words = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("word"), (F.col("n_regionkey") % 2).alias("pos"), F.col("n_nationkey").alias("offset"))
    synsets = _read(spark, sf_dir, "region").select((F.col("r_regionkey") % 2).alias("pos"), (F.col("r_regionkey") * 5).alias("off30"), F.col("r_name").alias("category"))
    return lexicon.affect_words(words, synsets)


@query("SELECT doc_id, max(quality) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id")
def optional_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-09: items with a score where there is one."""
    return metrics.with_model_score(_read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "labels"), "doc_id", "quality")


@query("SELECT event_id, coalesce(c_name, 'unknown') AS c_name FROM events LEFT JOIN customer ON user_id = c_custkey")
def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-16: rows with metadata, or unknown."""
    names = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return readers.with_metadata(_read(spark, sf_dir, "events"), names, "user_id", ["c_name"]).select("event_id", "c_name")


_FIRST_GOLDEN = ", ".join(f"({i}, '{found[0][0]}')" for i, (_, found) in enumerate(GOLDEN) if len(found) == 1)


@query(f"SELECT 'v' || c_custkey AS video_id, p AS pattern, 'https://www.youtube.com/watch?v=v' || c_custkey || '&t=' || c_custkey || 's' AS youtube_url FROM customer JOIN (VALUES {_FIRST_GOLDEN}) g(i, p) ON c_custkey % {len(GOLDEN)} = i")
def subtitle_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13: pages of a subtitle API in JSON, flattened to hits, and matched; sentences with a single match."""
    single = F.array(*[F.lit(t if len(found) == 1 else "") for t, found in GOLDEN])
    token = F.get(single, (F.col("c_custkey") % len(GOLDEN)).cast("int"))
    hit = F.struct((F.col("c_custkey") + 0.5).cast("string").alias("start"), F.lit("1").alias("dur"), F.lit("").alias("ctx_before"), token.alias("token"), F.lit(" ").alias("ctx_after"))
    video = F.struct(F.concat(F.lit("v"), "c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("c").alias("channelName"), F.lit(5).alias("viewCount"), F.array(hit).alias("hits"))
    pages = _customers(spark, sf_dir).select(F.to_json(F.struct(F.array(video).alias("result"))).alias("body")).select(readers.parsed_page(F.col("body")).alias("p")).select("p.*")
    return patterns.candidates(readers.subtitle_hits(pages), _states(spark), text="full_context").select("video_id", "pattern", "youtube_url")


@query("SELECT user_id, list_filter(list_sort(list(DISTINCT event_type)), lambda x: len(list_filter(votes, lambda v: v = x)) >= 0.3::DOUBLE * len(votes)) AS voted FROM (SELECT user_id, event_type, list(event_type) OVER (PARTITION BY user_id) AS votes FROM events) GROUP BY user_id, votes")
def voted_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10: the labels with a share of the votes."""
    votes = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("v"))
    return votes.select("user_id", mining.vote(F.col("v")).alias("voted"))


@query("SELECT conv_id, turn, list_resize(string_split(text, ' ')[1:5], 5, '') AS words FROM conversations")
def padded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-10: predictions filled up to a length."""
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", metrics.padded(F.split("text", " "), 5).alias("words"))


@query(r"SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: regexp_matches(regexp_replace(w, '^\s+|\s+$', '', 'g'), '^\p{L}{2,}$'))[1:50] AS words FROM conversations")
def whole_word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17: tokens that are whole words."""
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.whole_words(F.split("text", " ")).alias("words"))


@query("SELECT event_id, ['a' || event_id, event_type] AS labels, 'a' || event_id || ' ' || event_type AS target FROM events")
def literal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-02, TXT-33: list literals as arrays, and joined."""
    literal = F.concat(F.lit("['a"), F.col("event_id").cast("string"), F.lit("', '"), F.col("event_type"), F.lit("']"))
    return _read(spark, sf_dir, "events").select("event_id", T.literal_list(literal).alias("labels")).withColumn("target", T.supervision_target(F.col("labels")))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'v' || item_id ELSE text END AS text, text AS text_original FROM benchmark")
def promoted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-06: a variant's text in the place of the text."""
    rows = _read(spark, sf_dir, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("v"), "item_id")).otherwise("").alias("text_light"))
    return corpus.promoted(rows, "text_light", kept="text_original").select("item_id", "text", "text_original")


@query("SELECT doc_id, upper(source) AS shown FROM documents")
def mapped_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-19: a costly mapping of distinct values only."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return corpus.mapped_distinct(docs, "source", lambda d: d.withColumn("shown", F.upper("source")), "shown").select("doc_id", "shown")


@query("SELECT word, list_sort(list(DISTINCT emotion)) AS emotions FROM (SELECT lower(p_brand) word, p_name emotion FROM part WHERE p_size < 10 UNION ALL SELECT lower(p_brand), p_type FROM part WHERE p_size > 45) GROUP BY word")
def words_to_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-31: the union of a word's emotions over lexicons."""
    part = _read(spark, sf_dir, "part")
    one = lambda where, c: part.filter(where).select(F.lower("p_brand").alias("word"), F.array(c).alias("emotions"))
    return lexicon.words_to_emotions([one("p_size < 10", "p_name"), one("p_size > 45", "p_type")])


@query("SELECT word, kind FROM (SELECT word, kind, row_number() OVER (PARTITION BY word ORDER BY prio DESC) rn FROM (SELECT DISTINCT lower(p_brand) word, 'small' kind, 0 prio FROM part WHERE p_size < 5 UNION ALL SELECT DISTINCT lower(p_brand), 'middle', 1 FROM part WHERE p_size < 25)) WHERE rn = 1")
def overlaid_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-02, LEX-02: dictionaries laid over each other."""
    part = _read(spark, sf_dir, "part")
    some = lambda c, kind: part.filter(c).select(F.lower("p_brand").alias("word")).distinct().withColumn("kind", F.lit(kind))
    return lexicon.overlay([some("p_size < 5", "small"), some("p_size < 25", "middle")]).select("word", "kind")


@query("SELECT sum(length(text)) / sum(len(string_split(text, ' '))) AS fertility FROM conversations")
def characters_a_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-29: tokens per word; characters play the tokens."""
    rows = _read(spark, sf_dir, "conversations").select(F.filter(F.split("text", ""), lambda c: c != "").alias("tokens"), F.split("text", " ").alias("words"))
    return T.fertility(rows, "tokens", "words")


@query("SELECT item_id, replace(text, 'the', '<extra_id_0>') AS input, '<extra_id_0> the' AS target, 'Find the word.' AS system, text AS asked FROM benchmark")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-19, TXT-34, PRJ-09: the rows that trainers read."""
    rows = _read(spark, sf_dir, "benchmark").select("item_id", T.training_pair(F.col("text"), F.lit("the"), mask="the").alias("p"), T.chat(F.lit("Find the word."), F.col("text")).alias("m"))
    return rows.select("item_id", "p.input", "p.target", F.get("m", F.lit(0))["content"].alias("system"), F.get("m", F.lit(1))["content"].alias("asked"))


@query(r"SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS clean FROM benchmark")
def baseline_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-36: texts as the classical baselines read them."""
    return _read(spark, sf_dir, "benchmark").select("item_id", T.baseline_clean(F.col("text")).alias("clean"))


@query("SELECT role, avg(turn) AS turn, avg(conv_id) AS conv_id FROM conversations GROUP BY role")
def mean_of_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-28: means over repeats."""
    return corpus.repeats_mean(_read(spark, sf_dir, "conversations").select("role", "turn", "conv_id"), "role")


@query("SELECT conv_id, CASE WHEN min(CASE role WHEN 'user' THEN 0 WHEN 'system' THEN 1 ELSE 2 END) = 0 THEN 'user' WHEN min(CASE role WHEN 'user' THEN 0 WHEN 'system' THEN 1 ELSE 2 END) = 1 THEN 'system' END AS role FROM conversations WHERE role IN ('user', 'system') AND length(text) >= 20 GROUP BY conv_id")
def preferred_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05, SRC-27: of each key's long enough texts the first kind in order."""
    return readers.preferred(_read(spark, sf_dir, "conversations"), "conv_id", "role", ["user", "system"], shortest=20).select("conv_id", "role")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality = 1) / count(*) AS good_rate, count(*) FILTER (WHERE toxic = 1) / count(*) AS toxic_rate FROM labels")
def label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-14: counts of outcomes and their shares."""
    return metrics.shares(_read(spark, sf_dir, "labels"), good=F.col("quality") == 1, toxic=F.col("toxic") == 1)


# --- Streams


def _stream_result(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], mode: str, files: int = 4) -> DataFrame:
    """Runs a stream over events, landed in several files, to its end, a file a batch; returns its output from the shared folder.

    In complete mode each batch has all rows so far, so the last batch's are the result.
    """
    events, folder = _read(spark, sf_dir, "events"), f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    events.repartition(files, "event_id").write.parquet(f"{folder}/in")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    last = {"batch": -1}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        last["batch"] = max(last["batch"], number)

    run = build(crawl.file_stream(spark, f"{folder}/in", schema, files=1)).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out/batch={last['batch']}") if mode == "complete" else spark.read.parquet(f"{folder}/out").drop("batch")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01: stateful deduplication of a stream, equal to the batch form."""
    return _stream_result(spark, sf_dir, lambda s: crawl.first_seen(s.select("user_id", "event_type"), ["user_id", "event_type"]), "append")


@query("SELECT CASE WHEN value < 10 THEN 'low' WHEN event_type = 'click' THEN 'click' ELSE 'passed' END AS reason, count(*) AS n FROM events GROUP BY 1")
def stream_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06: reason counts of a stream."""
    rules = [("low", F.col("value") < 10), ("click", F.col("event_type") == "click")]
    return _stream_result(spark, sf_dir, lambda s: crawl.reason_counts(s, rules), "complete")


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, sum(n_chars) AS chars FROM documents WHERE n_chars >= 500")
def collected_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02 to STR-05: files as a stream, filtered in batches, collected in two runs; the second goes on from the checkpoint."""
    folder = f"{scratch(spark)}/collected-{uuid.uuid4().hex}"
    docs = _read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    docs.repartition(4, "doc_id").write.parquet(f"{folder}/in")
    kept = lambda df: df.filter("n_chars >= 500")
    for most in (1, 1 << 60):
        crawl.collect_until(crawl.file_stream(spark, f"{folder}/in", docs.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), files=1), f"{folder}/out", f"{folder}/checkpoint", most, kept)
    return spark.read.parquet(f"{folder}/out").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.sum("n_chars").alias("chars"))
