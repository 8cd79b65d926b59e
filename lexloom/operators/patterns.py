"""Phrase templates over a lexicon: matching with offsets, discovery frames, conjunction frames, re-verification of spans.

Templates are rows: a verb frame and whether only nouns may follow. A template matches ``frame``, an optional intensifier, and a seed
word, on folded text. Two strategies give the same rows: ``regex`` scans for each template's frame; ``tokens`` scans once for the words on
which frames end. Both look up the word behind in a hash set; a seed is one word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Template:
    name: str
    category: str
    frame: str
    noun_only: bool = False


# The optional intensifier, and the templates in order of precedence, as expressions on folded text.
MODIFIER = r"(?:(?:foarte|mai|putin|cam|destul\s+de|asa\s+de|tot|deja|chiar|atat\s+de)\s+)?"
TEMPLATES = (
    Template("ma_simt_present", "primary", r"(?:ma|me)\s+simt"),
    Template("ma_simteam_imperfect", "primary", r"(?:ma|me)\s+simteam"),
    Template("mam_simtit_perfect", "primary", r"m-?am\s+simtit"),
    Template("ma_voi_simti_future", "primary", r"(?:ma|me)\s+voi\s+simti"),
    Template("o_sa_ma_simt_future", "primary", r"o\s+sa\s+ma\s+simt"),
    Template("mas_simti_conditional", "primary", r"m-?as\s+simti"),
    Template("sa_ma_simt_subjunctive", "primary", r"sa\s+ma\s+simt"),
    Template("simt_ca", "primary", r"simt\s+ca"),
    Template("simt_noun", "primary", r"simt", True),
    Template("simteam_noun", "primary", r"simteam", True),
    Template("sunt_adj_present", "secondary", r"sunt"),
    Template("eram_adj_imperfect", "secondary", r"eram"),
    Template("am_fost_adj_perfect", "secondary", r"am\s+fost"),
    Template("o_sa_fiu_future", "secondary", r"o\s+sa\s+fiu"),
    Template("ma_fac_reflexive", "secondary", r"ma\s+fac"),
    Template("imi_este_present", "secondary", r"imi\s+este", True),
    Template("imi_era_imperfect", "secondary", r"imi\s+era", True),
    Template("mie_short", "secondary", r"mi-?[ei]", True),
    Template("am_noun_present", "secondary", r"am", True),
    Template("aveam_noun_imperfect", "secondary", r"aveam", True),
)
# The forms of the first person plural that the archived set has.
PLURAL_TEMPLATES = (
    Template("ne_simtim_present", "primary", r"ne\s+simtim"),
    Template("neam_simtit_perfect", "primary", r"ne-?am\s+simtit"),
    Template("suntem_adj_present", "secondary", r"suntem"),
)
# Substrings (lower case) of which a page must hold one to be matched at all.
TRIGGERS = (
    "simt", "sunt", "eram", "fost", "mi-e", "mie", "imi", "îmi", "simteam", "simțeam", "simtit", "simțit",
    "o sa ma simt", "o sa fiu", "m-as simti", "m-aș simți", "sa ma simt", "să mă simt", "ma fac",
)
# Phrases to search subtitles by, with and without diacritics.
QUERIES = ('"mă simt"', '"mi-e"', '"m-am simțit"', '"îmi este"', '"mă simțeam"', '"simt că"', '"îmi era"', '"mă voi simți"', '"o să mă simt"', '"m-aș simți"', '"să mă simt"')
PLAIN_QUERIES = ('"ma simt"', '"m-am simtit"', '"imi este"', '"imi era"', '"ma simteam"', '"o sa ma simt"', '"m-as simti"', '"sa ma simt"', '"o sa fiu"', '"o să fiu"')
# Names of the archived set of templates, in order, and the archived frames that name one state.
ARCHIVED = (
    "ma_simt_present", "ma_simteam_imperfect", "mam_simtit_perfect", "ma_voi_simti_future", "simt_ca", "simt_noun", "simteam_noun", "ne_simtim_present", "neam_simtit_perfect",
    "sunt_adj_present", "eram_adj_imperfect", "am_fost_adj_perfect", "suntem_adj_present", "imi_este_present", "imi_era_imperfect", "mie_short", "am_noun_present", "aveam_noun_imperfect",
)
ARCHIVED_DISCOVERY = (
    ("sentiment_de", r"un\s+sentiment\s+de\s+"), ("sentimentul_de", r"sentimentul\s+de\s+"), ("stare_de", r"o\s+stare\s+de\s+"), ("starea_de", r"starea\s+de\s+"), ("emotie_de", r"emoti[ae]\s+de\s+"),
    ("senzatie_de", r"o\s+senzatie\s+de\s+"), ("plin_de", r"plina?\s+de\s+"), ("cuprins_de", r"cuprinsa?\s+de\s+"), ("coplesit_de", r"coplesita?\s+de\s+"),
)
# Verbs and conjunctions of two coordinated states, and frames that name one.
CONJUNCTION_VERBS = (r"ma\s+simt", r"m-?am\s+simtit", r"ma\s+simteam", r"o\s+sa\s+ma\s+simt", r"m-?as\s+simti", r"sa\s+ma\s+simt")
CONJUNCTIONS = r"(?:dar\s+si|ba\s+chiar|si|dar|insa)"
DISCOVERY = (("sentiment_de", r"un\s+sentiment\s+de\s+"), ("sentimentul_de", r"sentimentul\s+de\s+"), ("emotie_de", r"emoti[ae]\s+de\s+"), ("senzatie_de", r"o\s+senzatie\s+de\s+"), ("coplesit_de", r"coplesita?\s+de\s+"))

WORD = r"[\p{L}\p{N}_]"
# Nouns (folded) that noun-only templates take even if the lexicon hasn't got them, and their emotions.
NOUN_EMOTIONS = {
    "frica": ["fear"], "teama": ["fear"], "groaza": ["fear"], "panica": ["fear"], "anxietate": ["fear"], "neliniste": ["fear"], "ingrijorare": ["fear"],
    "tristete": ["sadness"], "durere": ["sadness"], "suferinta": ["sadness"], "chin": ["sadness"], "dezamagire": ["sadness"], "melancolie": ["sadness"],
    "nostalgie": ["sadness"], "dor": ["sadness"],
    "bucurie": ["joy"], "fericire": ["joy"], "placere": ["joy"], "satisfactie": ["joy"], "entuziasm": ["joy", "anticipation"], "veselie": ["joy"],
    "furie": ["anger"], "manie": ["anger"], "nervozitate": ["anger", "fear"], "iritare": ["anger"], "frustrare": ["anger", "sadness"],
    "indignare": ["anger"], "revolta": ["anger"], "ura": ["anger", "disgust"],
    "dezgust": ["disgust"], "scarba": ["disgust"], "greata": ["disgust"], "repulsie": ["disgust"],
    "surpriza": ["surprise"], "uimire": ["surprise"], "mirare": ["surprise"], "stupoare": ["surprise"],
    "incredere": ["trust"], "siguranta": ["trust"], "liniste": ["trust"], "pace": ["trust"], "calm": ["trust"],
    "rusine": ["sadness", "fear"], "vina": ["sadness"], "gelozie": ["anger", "sadness"], "invidie": ["anger", "sadness"], "mandrie": ["joy"],
    "recunostinta": ["joy", "trust"], "iubire": ["joy", "trust"], "speranta": ["anticipation", "joy"], "disperare": ["sadness", "fear"],
    "nerabdare": ["anticipation"], "curiozitate": ["anticipation"],
}
# Further phrases to search by when all templates are to be found.
EXTRACTION_QUERIES = ('"sunt"', '"eram"', '"am fost"', '"mă fac"', '"ma fac"', '"aveam"')

FOUND = "array<struct<ord:int,start:int,end:int,seed_start:int,seed:string>>"
#: Words of a lexicon up to which it is sent to every executor.
LEXICON_WORDS = 1_000_000


def queries(secondary: bool = True, more: tuple[str, ...] = ()) -> tuple[str, ...]:
    """more: EXTRACTION_QUERIES, to search for what all templates may match."""
    return tuple(dict.fromkeys((*QUERIES, *(PLAIN_QUERIES if secondary else ()), *more)))


def query_grid(verbs: list[str], words: list[str], first: int) -> list[str]:
    """Quoted phrases of each verb with the first words."""
    return [f'"{v} {w}"' for v in verbs for w in words[:first]]


def archived_templates() -> tuple[Template, ...]:
    """The archived set: no futures with o sa, no conditional, subjunctive or reflexive, but the plural."""
    known = {t.name: t for t in (*TEMPLATES, *PLURAL_TEMPLATES)}
    return tuple(known[name] for name in ARCHIVED)


def has_trigger(text: Column, triggers: tuple[str, ...] = TRIGGERS) -> Column:
    """Whether the lower-case text, diacritics kept, holds any of triggers."""
    out = F.lit(False)
    for t in triggers:
        out = out | F.contains(F.lower(text), F.lit(t))
    return out


def has_trigger_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of words stands between characters that aren't letters."""
    return F.lower(text).rlike(r"(?<!\p{L})(?:" + "|".join(map(re.escape, words)) + r")(?!\p{L})")


def alternation(words: list[str]) -> str:
    """Folded distinct words, the longest first."""
    return "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def with_nouns(lexicon: DataFrame, nouns: dict[str, list[str]] | None = None) -> DataFrame:
    """word, noun, seed, emotions for ``find_matches``, of lexicon (word, emotions) and a table of nouns (NOUN_EMOTIONS by default).

    noun marks the words that noun-only templates take: those of the table. Nouns that only the table has aren't seeds of other templates.
    """
    nouns = NOUN_EMOTIONS if nouns is None else nouns
    table = lexicon.sparkSession.createDataFrame([(w, e) for w, e in nouns.items()], "word string, own array<string>")
    every = lexicon.groupBy(T.normalize(F.col("word")).alias("word")).agg(F.flatten(F.collect_list("emotions")).alias("emotions"), F.lit(True).alias("seed")).join(F.broadcast(table), "word", "full_outer")
    emotions = F.when(F.size("emotions") > 0, F.col("emotions")).otherwise(F.col("own"))
    return every.select("word", F.col("own").isNotNull().alias("noun"), F.coalesce("seed", F.lit(False)).alias("seed"), emotions.alias("emotions"))


def lexicon_words(lexicon: DataFrame) -> list:
    """The lexicon's words with any emotion; it is a parameter of the expressions, so it comes to the driver."""
    seed = F.col("seed") if "seed" in lexicon.columns else F.lit(True)
    words = lexicon.groupBy("word").agg(F.bool_or("noun").alias("noun"), F.bool_or(seed).alias("seed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("emotions")))).alias("emotions"))
    return words.filter(F.size("emotions") > 0).orderBy("word").collect()


def matches_of(fold: Column, words: list, templates: tuple[Template, ...] = TEMPLATES, strategy: str = "tokens", modifier: str = MODIFIER, most: int | None = None) -> Column:
    """FOUND: the matches of templates in searchable text, by template and place; the first ``most`` of them.

    ``tokens`` scans once for the words on which frames end, looks up the word behind each in a hash set, and tests frames on what lies
    before only there. ``regex`` scans once per template for its frame and looks the word up, too; it needs no frame to end on a word of its own.
    """
    every, nouns = [r["word"] for r in words if r["seed"]], [r["word"] for r in words if r["noun"]]
    if not words or not templates:
        return F.array().cast(FOUND)
    if strategy == "regex":
        each = [_one_by_one(fold, i, t, nouns if t.noun_only else every, modifier) for i, t in enumerate(templates)]
    else:
        shape = rf"(?<!{WORD})(?:{'|'.join(sorted({_tail(t) for t in templates}))})\s+(?=({modifier})({WORD}+))"
        reach = max(len(re.findall(r"\\s", t.frame)) + t.frame.count(" ") for t in templates)
        seeds = F.filter(F.transform(_leads(fold, shape, reach), lambda h: _seeded(h, sorted({*every, *nouns}))), lambda h: h["seed"].isNotNull())
        each = [T.let(seeds, lambda s: F.flatten(F.array(*[_framed_by(s, i, t, nouns if t.noun_only else every, len(words)) for i, t in enumerate(templates)])))]
    both = F.flatten(F.array(*each)) if strategy == "regex" else each[0]
    return both if most is None else F.slice(both, 1, most)


def _tail(t: Template) -> str:
    """The expression of a frame's last word: what follows its last blank outside groups and classes."""
    depth, cut, i = 0, 0, 0
    while i < len(t.frame):
        c = t.frame[i]
        if t.frame.startswith((r"\s+", r"\s*"), i) and not depth:
            i = cut = i + 3
            continue
        if c == " " and not depth:
            cut = i + 1
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(c, 0)
        i += 2 if c == "\\" else 1
    return t.frame[cut:]


def _leads(fold: Column, shape: str, reach: int) -> Column:
    """array<struct<lead, tail, modifier, word, end>>: places where a frame may end; lead is the text before with at least reach words.

    Each place has at least a word, so reach places back there are words enough, however many blanks lie between.
    """
    shown = T.MARK + T.PART.join(("$0", "$1", "$2")) + T.MARK
    pieces = F.split(F.regexp_replace(fold, shape, shown), T.MARK, -1)

    def placed(p: Column) -> Column:
        text = F.transform(p, lambda x: F.substring_index(x, T.PART, 1))  # gaps and frame ends in turn
        at = F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))

        def one(t: Column) -> Column:
            return T.let(T.running_sums(F.transform(t, lambda x: F.length(x))), lambda sums: F.transform(at, lambda i: F.struct(
                F.array_join(F.slice(t, F.greatest(i - 2 * reach, F.lit(0)) + 1, F.least(i, F.lit(2 * reach))), "").alias("lead"), F.get(t, i).alias("tail"),
                F.get(F.split(F.get(p, i), T.PART, 3), F.lit(1)).alias("modifier"), F.get(F.split(F.get(p, i), T.PART, 3), F.lit(2)).alias("word"), F.get(sums, i).cast("int").alias("end"),
            )))

        return T.let(text, one)

    kind = "array<struct<lead:string,tail:string,modifier:string,word:string,end:int>>"
    return T.let(pieces, lambda p: F.when(F.size(p) > 1, placed(p)).otherwise(F.array().cast(kind)))


def _seeded(h: Column, words: list[str]) -> Column:
    """A place with the seed that follows: the word after an intensifier, else the intensifier's own first word; null if neither is one."""
    first = F.regexp_extract(h["modifier"], rf"^{WORD}+", 0)
    own = h["word"].isin(words)
    seed = F.when(own, h["word"]).when((h["modifier"] != "") & first.isin(words), first)
    start = h["end"] + F.when(own, F.length(h["modifier"])).otherwise(0)
    return F.struct(h["lead"].alias("lead"), h["tail"].alias("tail"), h["end"].alias("frame_end"), start.alias("seed_start"), seed.alias("seed"))


def _framed_by(seeds: Column, i: int, t: Template, words: list[str], known: int) -> Column:
    """The matches of one template among places with seeds."""
    last, whole = _tail(t), t.frame
    own = F.filter(seeds, lambda s: s["tail"].rlike(rf"^(?:{last})\s") & (s["seed"].isin(words) if len(words) < known else F.lit(True)))
    single = last == whole
    length = lambda s: F.length(s["tail"]) if single else F.length(F.regexp_extract(F.concat(s["lead"], s["tail"]), rf"(?<!{WORD})(?:{whole})\s+$", 0))
    found = F.transform(own, lambda s: T.let(length(s), lambda n: F.struct(F.lit(i).alias("ord"), F.when(n > 0, s["frame_end"] - n).alias("start"), (s["seed_start"] + F.length(s["seed"])).alias("end"), s["seed_start"].alias("seed_start"), s["seed"].alias("seed"))))
    return _apart(F.filter(found, lambda h: h["start"].isNotNull()))


def _apart(hits: Column) -> Column:
    """Matches in order without those that begin inside one that stays."""
    return _leftmost(hits, FOUND)


def _leftmost(hits: Column, kind: str) -> Column:
    """Hits (of kind, with start and end) in order without those that begin inside one that stays; seldom any does, so all are walked only then."""
    none = F.array().cast(kind)

    def walk(h: Column) -> Column:
        kept = lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(x)).alias("out")))
        return F.aggregate(h, F.struct(F.lit(0).alias("at"), none.alias("out")), kept, lambda acc: acc["out"])

    return T.let(hits, lambda h: F.when(F.exists(F.transform(h, lambda x, i: F.coalesce(x["start"] < F.get(h, i - 1)["end"], F.lit(False))), lambda x: x), walk(h)).otherwise(h))


def _one_by_one(fold: Column, i: int, t: Template, words: list[str], modifier: str) -> Column:
    """The matches of one template by its own scan. A frame found is left before its seed, where the next may begin."""
    places = T.found(fold, rf"(?<!{WORD})(?:{t.frame})\s+(?=({modifier})({WORD}+))", 1, 2)
    part = lambda h, k: F.get(h["parts"], F.lit(k))

    def one(h: Column) -> Column:
        s = _seeded(F.struct(F.lit("").alias("lead"), part(h, 0).alias("tail"), part(h, 1).alias("modifier"), part(h, 2).alias("word"), h["end"].alias("end")), words)
        return F.struct(F.lit(i).alias("ord"), h["start"].alias("start"), (s["seed_start"] + F.length(s["seed"])).alias("end"), s["seed_start"].alias("seed_start"), s["seed"].alias("seed"))

    return _apart(F.filter(F.transform(places, one), lambda h: h["seed"].isNotNull())) if words else F.array().cast(FOUND)


def _exploded(rows: DataFrame, hits: Column, words: list, templates: tuple[Template, ...], keep: list[str]) -> DataFrame:
    """keep, pattern, category, ord, …: a row for each match, with its template and emotions."""
    spark = rows.sparkSession
    emotions = spark.createDataFrame([(r["word"], r["emotions"]) for r in words], "_word string, emotions array<string>")
    emotions = F.broadcast(emotions) if len(words) <= LEXICON_WORDS else emotions
    names, kinds = (F.array(*[F.lit(x) for x in of]) if of else F.array().cast("array<string>") for of in ([t.name for t in templates], [t.category for t in templates]))
    out = rows.select(*keep, F.explode(hits).alias("_hit")).select(*keep, "_hit.*").join(emotions, F.col("seed") == F.col("_word")).drop("_word")
    return out.withColumn("pattern", F.get(names, F.col("ord"))).withColumn("category", F.get(kinds, F.col("ord")))


def find_matches(docs: DataFrame, lexicon: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, strategy: str = "tokens", most: int | None = 100, modifier: str = MODIFIER) -> DataFrame:
    """A row for each match: docs' columns, ord (of the template), start, end, seed_start, seed, emotions, pattern, category.

    lexicon: word (folded, one word), noun (boolean), emotions (array<string>), and perhaps seed (boolean; see ``with_nouns``). Noun-only
    templates take words with noun, others words with seed, all if there is no such column. Per document the first ``most`` matches in
    order of template and place stay (None: all). Null texts match nothing. Rows stay where they are: there is no shuffle.
    """
    words = lexicon_words(lexicon)
    rows = with_hits(docs, words, text, templates, strategy, most, modifier)
    return exploded(rows, words, docs.columns, templates=templates)


def with_hits(docs: DataFrame, words: list, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, strategy: str = "tokens", most: int | None = 100, modifier: str = MODIFIER) -> DataFrame:
    """docs with _fold (the searchable text) and _hits (FOUND): every row stays, also without a match. words: see ``lexicon_words``."""
    rows = docs.withColumn("_fold", T.searchable(F.col(text)))
    return rows.withColumn("_hits", matches_of(F.col("_fold"), words, templates, strategy, modifier, most))


def exploded(rows: DataFrame, words: list, keep: list[str], templates: tuple[Template, ...] = TEMPLATES, **_) -> DataFrame:
    """A row for each of _hits (see ``with_hits``), with its template and emotions."""
    return _exploded(rows, F.col("_hits"), words, templates, keep)


def distinct_matches(docs: DataFrame, lexicon: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, strategy: str = "tokens", modifier: str = MODIFIER) -> DataFrame:
    """docs' columns, pattern_used, seed_word_normalized, n: a row for each template and seed that match in a row, and how often they do.

    They are counted within the row, so rows stay where they are and nothing is joined.
    """
    rows = with_hits(docs, lexicon_words(lexicon), text, templates, strategy, None, modifier)
    names = F.array(*[F.lit(t.name) for t in templates])
    own = F.transform("_hits", lambda h: F.struct(F.get(names, h["ord"]).alias("pattern_used"), h["seed"].alias("seed_word_normalized")))
    counted = T.let(own, lambda all_: F.transform(F.array_distinct(all_), lambda k: k.withField("n", F.size(F.filter(all_, lambda h: h == k)).cast("bigint"))))
    return rows.select(*docs.columns, F.explode(counted).alias("_m")).select(*docs.columns, "_m.*")


def first_match(docs: DataFrame, lexicon: DataFrame, **options) -> DataFrame:
    """The first match of each row."""
    return find_matches(docs, lexicon, most=1, **options)


def candidates(docs: DataFrame, lexicon: DataFrame, key: str | None = None, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, strategy: str = "tokens", most: int | None = 100, modifier: str = MODIFIER) -> DataFrame:
    """Matches with their sentence and the seed as written; of one sentence of a row only the earliest template's stays.

    key: a column whose equal rows count as one document; the few rows that are left after that move by key and sentence. Without it
    each row is a document and nothing moves.
    """
    words = lexicon_words(lexicon)
    rows = docs.withColumn("_fold", T.searchable(F.col(text)))
    rows = rows.withColumn("_hits", F.transform(matches_of(F.col("_fold"), words, templates, strategy, modifier, most), lambda h: h.withField("matched_sentence", T.sentence_around(F.col(text), h["start"], h["end"]))))
    # Sorted by sentence, then template and place: the first of each sentence stays.
    ordered = F.array_sort(F.transform("_hits", lambda h: F.struct(h["matched_sentence"].alias("s"), h["ord"].alias("o"), h["start"].alias("a"), h.alias("h"))))
    firsts = T.let(ordered, lambda x: F.transform(F.filter(x, lambda h, i: (i == 0) | (h["s"] != F.get(x, i - 1)["s"])), lambda h: h["h"]))
    found = _exploded(rows, firsts, words, templates, docs.columns)
    if key is not None:
        order = Window.partitionBy(key, "matched_sentence").orderBy("ord", "start")
        found = found.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return found.withColumn("seed_word", T.original_word(F.col(text), F.col("start"), F.col("seed")))


def verify_spans(rows: DataFrame, templates: tuple[Template, ...] = TEMPLATES, modifier: str = MODIFIER) -> DataFrame:
    """rows (text, pattern_used, seed_word_normalized) with seed_word_start, seed_word_end, masked_text, verified.

    The named template is matched again with the row's own seed; its first hit is masked. A row fails without a hit, or if folding
    changes the text's length.
    """
    fold = T.normalize(F.col("text"))
    frame = F.create_map(*[x for t in templates for x in (F.lit(t.name), F.lit(t.frame))])[F.col("pattern_used")]
    shape = F.concat(F.lit(rf"(?<!{WORD})(?:"), frame, F.lit(rf")\s+{modifier}"), F.lit(r"\Q"), F.col("seed_word_normalized"), F.lit(rf"\E(?!{WORD})"))
    out = rows.withColumn("_fold", fold).withColumn("_gaps", F.split(F.col("_fold"), shape, 2))  # one scan, up to the first hit
    ok = F.coalesce((F.length("_fold") == F.length("text")) & (F.size("_gaps") > 1) & (F.length("seed_word_normalized") > 0), F.lit(False))
    end = F.length("_fold") - F.length(F.get("_gaps", F.lit(1)))
    out = out.withColumn("verified", ok).withColumn("seed_word_end", F.when(F.col("verified"), end)).withColumn("seed_word_start", F.col("seed_word_end") - F.length("seed_word_normalized"))
    return out.withColumn("masked_text", T.mask_span(F.col("text"), F.col("seed_word_start"), F.col("seed_word_end"))).drop("_fold", "_gaps")


def _pair_scan(verbs: tuple[str, ...], conjunctions: str, modifier: str, word: str) -> tuple[str, int]:
    """An expression that matches the empty string before each verb that begins a pair, and how many readings of the pair it captures.

    A reading is four groups: the whole pair, its verb, x and y. There is one with an intensifier before x and one without; and in each x is
    a whole word, or a word to whose end the conjunction is glued. Readings come in the order in which an alternation of known words tries them.
    """
    every = "|".join(verbs)
    begins = [modifier[:-1], ""] if modifier.endswith(")?") else [modifier]
    rest = rf"\s+{modifier}({word})"
    readings = [rf"(?=((?:nu\s+)?({every})\s+{m}({x}){rest}))" for m in begins for x in (rf"{WORD}++)\s*,?\s*(?:{conjunctions}|,", rf"{WORD}+?)(?:{conjunctions}")]
    any_ = rf"(?=(?:nu\s+)?(?:{every})\s+{modifier}{WORD}+?\s*,?\s*(?:{conjunctions}|,)\s+{modifier}{word})"
    return rf"(?<!{WORD}){any_}" + "".join(f"(?:{r})?" for r in readings), len(readings)


def _by_verb(verbs: tuple[str, ...], kind: str):
    """Hits of several verbs, each verb's leftmost ones that don't overlap."""

    def of(hits: Column, verb: str) -> Column:
        return _leftmost(F.filter(hits, lambda h: h["verb_form"].rlike(rf"^(?:{verb})$")) if len(verbs) > 1 else hits, kind)

    return lambda hits: F.flatten(F.array(*[of(hits, v) for v in verbs]))


def _scans(verbs: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Verbs by the scan that finds their pairs: one for all, but verbs of which one begins another are told apart by scans of their own."""
    apart = not any(a != b and re.match(rf"{re.escape(a)}(?:\\s|\s)", b) for a in verbs for b in verbs)
    return [verbs] if apart else [(v,) for v in verbs]


def _readings(fold: Column, verbs: tuple[str, ...], conjunctions: str, modifier: str, word: str) -> Column:
    """array<array<struct<start, readings>>>: by scan (see ``_scans``) the places of pairs with any word as x, and each place's readings in order."""

    def scan(some: tuple[str, ...]) -> Column:
        shape, n = _pair_scan(some, conjunctions, modifier, word)

        def one(h: Column) -> Column:
            part = lambda k, i: F.get(h["parts"], F.lit(4 * k + i))
            each = F.array(*[F.struct((h["start"] + F.length(part(k, 1))).alias("end"), part(k, 2).alias("verb_form"), part(k, 3).alias("x"), part(k, 4).alias("y")) for k in range(n)])
            return F.struct(h["start"].alias("start"), F.filter(each, lambda r: r["x"] != "").alias("readings"))

        return F.transform(T.found(fold, shape, *range(1, 4 * n + 1)), one)

    return F.array(*[scan(some) for some in _scans(verbs)])


def _paired(places: Column, seeds: list[str], verbs: tuple[str, ...]) -> Column:
    """array<struct<verb_form, x, y>> of places (see ``_readings``): of each verb the leftmost pairs that don't overlap, whose x is among seeds.

    x is looked up in a hash set; of a place's readings the first whose x is known counts.
    """
    kind = "array<struct<start:int,end:int,verb_form:string,x:string,y:string>>"
    if not seeds or not verbs:
        return F.array().cast("array<struct<verb_form:string,x:string,y:string>>")
    known = sorted({*seeds})

    def first(h: Column) -> Column:
        own = F.get(F.filter(h["readings"], lambda r: r["x"].isin(known)), F.lit(0))
        return T.let(own, lambda r: F.when(r.isNotNull(), F.struct(h["start"].alias("start"), *[r[n].alias(n) for n in ("end", "verb_form", "x", "y")]).cast(kind[6:-1])))

    each = [T.let(F.filter(F.transform(F.get(places, F.lit(i)), first), lambda h: h.isNotNull()), _by_verb(some, kind)) for i, some in enumerate(_scans(verbs))]
    return F.transform(F.flatten(F.array(*each)), lambda h: F.struct(F.left(h["verb_form"], F.lit(30)).alias("verb_form"), h["x"].alias("x"), h["y"].alias("y")))


def _pairs(fold: Column, seeds: list[str], verbs: tuple[str, ...], conjunctions: str, modifier: str, word: str) -> Column:
    return _paired(_readings(fold, verbs, conjunctions, modifier, word), seeds, verbs) if verbs else _paired(F.lit(None), seeds, verbs)


def _named(fold: Column, frames: tuple[tuple[str, str], ...]) -> Column:
    """array<struct<frame, word, start, end>>."""
    found = lambda name, shape: F.transform(T.found(fold, rf"(?<!{WORD})(?:{shape})({WORD}+)(?!{WORD})", 1), lambda h: F.struct(F.lit(name).alias("frame"), h["parts"][1].alias("word"), h["start"].alias("start"), h["end"].alias("end")))
    return F.flatten(F.array(*[found(name, shape) for name, shape in frames]))


def _context(fold: str, hit: str) -> Column:
    """40 code points before and after; a column of its own, so that it costs nothing where nobody reads it."""
    start, end = F.col(f"{hit}.start"), F.col(f"{hit}.end")
    return F.substring(F.col(fold), F.greatest(start - 39, F.lit(1)), end - start + 80)


def conjunction_pairs(docs: DataFrame, seeds: list[str], text: str = "text", verbs: tuple[str, ...] = CONJUNCTION_VERBS, conjunctions: str = CONJUNCTIONS, modifier: str = MODIFIER, word: str = f"{WORD}+") -> DataFrame:
    """docs' columns, verb_form, x (a seed), y: verb, seed x, conjunction or comma, and any word y, on folded text."""
    rows = docs.withColumn("_fold", T.searchable(F.col(text)))
    return rows.select(*docs.columns, F.explode(_pairs(F.col("_fold"), seeds, verbs, conjunctions, modifier, word)).alias("_p")).select(*docs.columns, "_p.*")


def pair_places(docs: DataFrame, text: str = "text", verbs: tuple[str, ...] = CONJUNCTION_VERBS, conjunctions: str = CONJUNCTIONS, modifier: str = MODIFIER, word: str = f"{WORD}+") -> DataFrame:
    """docs' other columns, _places: where pairs with any x are; ``pairs_at`` finds those of a lexicon without the texts.

    Every row stays: a filter on what was found would be pushed below it, and scan twice.
    """
    places = _readings(T.searchable(F.col(text)), verbs, conjunctions, modifier, word)
    return docs.select(*[c for c in docs.columns if c != text], places.alias("_places"))


def pairs_at(places: DataFrame, seeds: list[str], verbs: tuple[str, ...] = CONJUNCTION_VERBS, **_) -> DataFrame:
    """The rows of ``conjunction_pairs``, without the text, of what ``pair_places`` found with the same options."""
    keep = [c for c in places.columns if c != "_places"]
    return places.select(*keep, F.explode(_paired(F.col("_places"), seeds, verbs)).alias("_p")).select(*keep, "_p.*")


def discover(docs: DataFrame, text: str = "text", frames: tuple[tuple[str, str], ...] = DISCOVERY) -> DataFrame:
    """docs' columns, frame, word, context (40 code points around): a row for each word that a frame names."""
    rows = docs.withColumn("_fold", T.searchable(F.col(text)))
    hits = rows.select(*docs.columns, "_fold", F.explode(_named(F.col("_fold"), frames)).alias("_h"))
    return hits.select(*docs.columns, "_h.frame", "_h.word", _context("_fold", "_h").alias("context"))


def mined(docs: DataFrame, seeds: list[str], text: str = "text", frames: tuple[tuple[str, str], ...] = DISCOVERY, verbs: tuple[str, ...] = CONJUNCTION_VERBS, conjunctions: str = CONJUNCTIONS, modifier: str = MODIFIER, word: str = f"{WORD}+") -> DataFrame:
    """Both miners in one reading of the texts: docs' columns and either verb_form, x, y (a pair) or frame, word, context (a named word)."""
    fold = F.col("_fold")
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    own = lambda h, *names: [h[n].alias(n) for n in names]
    places = [F.lit(None).cast("int").alias(n) for n in ("start", "end")]
    pairs = F.transform(_pairs(fold, seeds, verbs, conjunctions, modifier, word), lambda h: F.struct(*own(h, "verb_form", "x", "y"), *none("frame", "word"), *places))
    named = F.transform(_named(fold, frames), lambda h: F.struct(*none("verb_form", "x", "y"), *own(h, "frame", "word", "start", "end")))
    rows = docs.withColumn("_fold", T.searchable(F.col(text)))
    hits = rows.select(*docs.columns, "_fold", F.explode(F.concat(pairs, named)).alias("_h"))
    return hits.select(*docs.columns, *[f"_h.{n}" for n in ("verb_form", "x", "y", "frame", "word")], _context("_fold", "_h").alias("context"))


def template_table(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(i, t.name, t.category, t.frame, t.noun_only) for i, t in enumerate(templates)], "ord int, name string, category string, frame string, noun_only boolean")
