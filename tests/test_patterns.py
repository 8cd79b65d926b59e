import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import lexicon, mining, patterns

WORDS = ["fericit", "trist", "frica", "teama", "furios", "bine", "rau", "calm", "relaxat", "surprins"]
NOUNS = {"frica", "teama", "calm"}
GOLDEN = {
    "Mă simt fericit astăzi.": [("ma_simt_present", 0, 15, 8, "fericit")],
    "Mă simt fericită și liberă.": [],
    "M-am simțit foarte bine la petrecere.": [("mam_simtit_perfect", 0, 23, 19, "bine")],
    "O să mă simt mai bine mâine.": [("ma_simt_present", 5, 21, 17, "bine"), ("o_sa_ma_simt_future", 0, 21, 17, "bine"), ("sa_ma_simt_subjunctive", 2, 21, 17, "bine")],
    "O să fiu trist fără tine.": [("o_sa_fiu_future", 0, 14, 9, "trist")],
    "M-aș simți mai relaxat acasă.": [("mas_simti_conditional", 0, 22, 15, "relaxat")],
    "Vreau să mă simt calm.": [("ma_simt_present", 9, 21, 17, "calm"), ("sa_ma_simt_subjunctive", 6, 21, 17, "calm"), ("simt_noun", 12, 21, 17, "calm")],
    "Mă fac fericit când aud muzică.": [("ma_fac_reflexive", 0, 14, 7, "fericit")],
    "Sunt furios pe situația actuală.": [("sunt_adj_present", 0, 11, 5, "furios")],
    "Mi-e frică de câini.": [("mie_short", 0, 10, 5, "frica")],
    "Îmi este teamă.": [("imi_este_present", 0, 14, 9, "teama")],
    "Ei sunt fericit.": [("sunt_adj_present", 3, 15, 8, "fericit")],
}


@pytest.fixture
def words(spark):
    return spark.createDataFrame([(w, w in NOUNS, ["x"]) for w in WORDS], "word string, noun boolean, emotions array<string>")


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(GOLDEN)] + [(99, None), (100, "")], "id int, text string")


@pytest.mark.parametrize("strategy", ["regex", "tokens"])
def test_golden_rows(docs, words, strategy):
    got = {}
    for r in patterns.find_matches(docs, words, strategy=strategy).orderBy("id", "ord").collect():
        got.setdefault(r.text, []).append((r.pattern, r.start, r.end, r.seed_start, r.seed))
    assert got == {t: rows for t, rows in GOLDEN.items() if rows}


def test_strategies_agree_on_dense_text(spark, words):
    text = " ".join(["am fost fericit sunt mai bine mi-e frică am teamă", "sunt trist și eram calm, mă simt cam rău; sunt foarte"] * 30)
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = lambda s: sorted(map(tuple, patterns.find_matches(df, words, strategy=s, most=10_000).drop("text", "emotions").collect()))
    assert rows("regex") == rows("tokens") and len(rows("tokens")) > 150
    assert patterns.find_matches(df, words, most=7).count() == 7


FRAMES = (
    patterns.Template("simt", "primary", r"simt"), patterns.Template("ma_simt", "primary", r"(?:ma|me)\s+simt"), patterns.Template("o_sa_ma", "primary", r"o\s+sa\s+ma\s+simt"),
    patterns.Template("am", "secondary", r"m-?am\s+simtit"), patterns.Template("noun", "secondary", r"mi-?[ei]", True),
)


PIECES = ("o", "sa", "mă", "me", "simt", "trist", "foarte", "mai", "frică", "m-am", "simțit", "mi-e", "mie", ",", ".", "asa", "de", "simt", "\ufdd0", "😀", "x" * 90)
BLANKS = (" ", " ", " ", "\n", "  ", " " * 100, "")


def test_strategies_and_plain_matching_agree(spark):
    """Whatever lies between words, however long: the same rows as one scan of each template for its frame and any seed."""
    rng = random.Random(17)
    texts = [[(rng.choice(PIECES), rng.choice(BLANKS)) for _ in range(rng.randrange(26))] for _ in range(500)]
    seeds, nouns = ["trist", "simt", "frica", "mai", "foarte"], ["frica"]
    lexicon_ = spark.createDataFrame([(w, w in nouns, ["x"]) for w in seeds], "word string, noun boolean, emotions array<string>")
    rows = [(i, "".join(a + b for a, b in t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string")
    want = []
    for i, t in rows:
        fold = t.lower().translate(str.maketrans(T.DIACRITICS + T.MARK + T.PART, T.FOLDED + "\ufffd\ufffd"))
        for t_ in FRAMES:
            words = "|".join(sorted(nouns if t_.noun_only else seeds, key=len, reverse=True))
            for m in re.finditer(rf"(?<!\w)(?:{t_.frame})\s+{patterns.MODIFIER}({words})(?!\w)", fold):
                want.append((i, t_.name, *m.span(), m.start(1), m[1]))
    for strategy in ("tokens", "regex"):
        found = patterns.find_matches(df, lexicon_, templates=FRAMES, strategy=strategy, most=None)
        got = [(r.id, r.pattern, r.start, r.end, r.seed_start, r.seed) for r in found.collect()]
        assert sorted(got) == sorted(want), strategy


def test_long_blanks_before_a_seed(spark, words):
    df = spark.createDataFrame([(1, "o sa" + " " * 100 + "ma simt trist")], "id int, text string")
    rows = lambda s: sorted((r.pattern, r.start, r.seed_start) for r in patterns.find_matches(df, words, strategy=s).collect())
    assert rows("tokens") == rows("regex") == [("ma_simt_present", 104, 112), ("o_sa_ma_simt_future", 0, 112), ("sa_ma_simt_subjunctive", 2, 112)]


def test_matches_move_no_text(docs, words):
    plan = patterns.candidates(docs, words)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Repartition" not in plan and plan.count("Join") == 1


def test_nouns_that_the_lexicon_lacks(spark):
    seeds = spark.createDataFrame([("Fericit", ["joy"]), ("teamă", [])], "word string, emotions array<string>")
    lexicon_ = patterns.with_nouns(seeds)
    df = spark.createDataFrame([(1, "Am dor. Sunt fericit, sunt dor. Mi-e teamă; am fericit.")], "id int, text string")
    got = {(r.pattern, r.seed, tuple(r.emotions)) for r in patterns.find_matches(df, lexicon_).collect()}
    assert got == {("am_noun_present", "dor", ("sadness",)), ("sunt_adj_present", "fericit", ("joy",)), ("mie_short", "teama", ("fear",))}


def test_many_hits_in_linear_time(spark, words):
    texts = {n: "sunt trist, " * n for n in (2_000, 20_000)}
    df = spark.createDataFrame(list(texts.items()), "n int, text string")
    got = patterns.find_matches(df, words, most=None).groupBy("n").agg(F.count("*").alias("k"), F.max("end").alias("last")).collect()
    assert {r.n: (r.k, r["last"]) for r in got} == {n: (n, 12 * n - 2) for n in texts}


def test_first_template_survives_per_sentence(docs, words):
    got = patterns.candidates(docs, words, "id").collect()
    assert {r.pattern for r in got if r.text.startswith("Vreau")} == {"ma_simt_present"}
    assert {r.seed_word for r in got if "câini" in r.text} == {"frică"} and all(r.matched_sentence in r.text for r in got)


def test_verified_spans(spark):
    rows = spark.createDataFrame([(1, "Azi mă simt Fericit.", "ma_simt_present", "fericit"), (2, "Nimic.", "ma_simt_present", "fericit"), (3, None, "ma_simt_present", "x"), (4, "Sunt bine", "no such", "bine")], "id int, text string, pattern_used string, seed_word_normalized string")
    got = {r.id: r for r in patterns.verify_spans(rows).collect()}
    assert got[1].masked_text == "Azi mă simt [MASK]." and (got[1].seed_word_start, got[1].seed_word_end) == (12, 19)
    assert [got[i].verified for i in (1, 2, 3, 4)] == [True, False, False, False] and got[2].masked_text is None


def test_discovery_and_conjunctions(spark):
    df = spark.createDataFrame([(1, "Am un sentiment de vinovăție. Coplesită de emoție! Mă simt trist și obosit, mă simt calm, liniștit.")], "id int, text string")
    assert {(r.frame, r.word) for r in patterns.discover(df).collect()} == {("sentiment_de", "vinovatie"), ("coplesit_de", "emotie")}
    assert {(r.x, r.y) for r in patterns.conjunction_pairs(df, ["trist", "calm"]).collect()} == {("trist", "obosit"), ("calm", "linistit")}
    assert df.select(patterns.has_trigger(F.col("text")).alias("t")).first().t
    assert not df.select(patterns.has_trigger_word(F.col("text"), ("sim",)).alias("t")).first().t


def test_queries():
    assert patterns.queries(False)[0] == '"mă simt"' and len(set(patterns.queries())) == len(patterns.queries())
    assert patterns.query_grid(["sunt"], ["a", "b", "c"], 2) == ['"sunt a"', '"sunt b"']
    names = [t.name for t in patterns.TEMPLATES]
    assert len(names) == len(set(names)) == 20 and sum(t.noun_only for t in patterns.TEMPLATES) == 7


def test_lexicon_expansion(spark):
    seed = spark.createDataFrame([("fericit", "adjective", ["joy"]), ("frică", "noun", ["fear"]), ("curios", "adjective", ["hope"])], "word string, pos string, emotions array<string>")
    table = spark.createDataFrame([("fericită", "fericit", "Afpfsrn"), ("fericiți", "fericit", "Afpmprn"), ("fericita", "fericit", "Afpfsry"), ("frica", "frică", "Ncfsry")], "form string, lemma string, msd string")
    got = {r.word: (r.noun, r.emotions) for r in lexicon.expand(seed, table).collect()}
    assert got == {"fericit": (False, ["joy"]), "fericita": (False, ["joy"]), "frica": (True, ["fear"]), "curios": (False, ["hope"]), "curioasa": (False, ["hope"])}
    assert {r.word for r in lexicon.expand(seed, None).collect()} == {"fericit", "frica", "curios"}


def test_bootstrap_stops_when_no_word_is_new(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["mă simt trist și obosit", "mă simt calm și obosit", "m-am simțit obosit și absent", "mă simt trist și absent", "mă simt trist și de acord", "mă simt trist și calm"])], "id int, text string")
    seeds = spark.createDataFrame([("trist", "m", ["sadness"]), ("calm", "m", ["trust"])], "word string, gender string, emotions array<string>")
    stop = spark.createDataFrame([("de",)], "word string")
    found, history = mining.bootstrap(docs, seeds, stop)
    assert {r.word for r in found.collect()} == {"trist", "calm", "obosit", "absent"}
    rounds = history.orderBy("round").collect()
    assert [r.accepted for r in rounds] == [1, 1, 0] and rounds[0].rejected_reasons["too_short"] == 1
    assert {r.word: r.emotions for r in found.collect()}["obosit"] == ["sadness", "trust"]


def test_pairs_in_one_scan_equal_a_scan_for_each_verb(spark):
    """Glued conjunctions, intensifiers that are seeds, verbs within verbs, on random texts."""
    rng = random.Random(5)
    words = ("ma simt", "m-am simtit", "ma", "simt", "trist", "calm", "foarte", "mai", "si", "dar si", "nu", "o sa ma simt", "sa ma simt", ",", "insa", "bine", "tristsi", "calm,", "xdar", "destul de", "asa", "tristdar", "fericit")
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4, 60)))) for i in range(400)]
    seeds = ["trist", "calm", "bine", "foarte", "fericit", "x"]
    want = []
    for verb in patterns.CONJUNCTION_VERBS:
        shape = rf"(?<!{patterns.WORD})(?:nu\s+)?({verb})\s+{patterns.MODIFIER}({patterns.alternation(seeds)})\s*,?\s*(?:{patterns.CONJUNCTIONS}|,)\s+{patterns.MODIFIER}({patterns.WORD}+)"
        want += [(i, m[1], m[2], m[3]) for i, t in docs for m in regex.finditer(shape, t)]
    got = [(r.id, r.verb_form, r.x, r.y) for r in patterns.conjunction_pairs(spark.createDataFrame(docs, "id int, text string"), seeds).collect()]
    assert sorted(got) == sorted(want) and len(want) > 500
    one, two = (patterns.conjunction_pairs(spark.createDataFrame([(1, "a b trist si calm")], "id int, text string"), seeds, verbs=v, modifier="").collect() for v in (("a", "a b"), ("a b",)))
    assert [r.y for r in one] == [r.y for r in two] == ["calm"]


def test_bootstrap_scans_texts_once(spark, tmp_path):
    """Rounds look words up in the places of pairs, which are as those of a scan with the words; the texts are read once."""
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    pairs = [("bine", "nou"), ("liber", "nou"), ("nou", "vechi"), ("bine", "vechi"), ("vechi", "greu"), ("nou", "greu")]
    texts = [f"Ma simt {x} si {y}, m-am simtit foarte {x}, {y}. Ma simt ma simt {x} si {y} si {x}." for x, y in pairs]
    docs = spark.createDataFrame([(t,) for t in texts], "raw string").select(F.udf(counted, "string").asNondeterministic()("raw").alias("text"))
    seeds = spark.createDataFrame([(w, "m", ["joy"]) for w in ("bine", "liber")], "word string, gender string, emotions array<string>")
    found, history = mining.bootstrap(docs, seeds, spark.createDataFrame([("si",)], "word string"))
    assert {r.word for r in found.collect()} == {"bine", "liber", "nou", "vechi", "greu"} and history.count() == 4
    assert read.value == len(texts)
    plain = spark.createDataFrame([(t,) for t in texts], "text string")
    for words in (["bine"], ["bine", "nou", "si"], []):
        at = patterns.pairs_at(patterns.pair_places(plain), words).collect()
        assert sorted(map(tuple, at)) == sorted(tuple(r)[1:] for r in patterns.conjunction_pairs(plain, words).collect())
