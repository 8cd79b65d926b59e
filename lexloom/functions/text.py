"""Scalar text functions as native columns. Lengths and offsets count code points; null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Letters with diacritics, cedilla forms included, and what they fold to.
DIACRITICS, FOLDED = "ăâîșțĂÂÎȘȚşţŞŢ", "aaistAAISTstST"

# Suffixes that tell a word's gender (folded), and rewrites (end, letters cut, letters added) that give
# a feminine form, in order.
FEMININE = ("a", "oasa", "easca", "ica", "ita", "ata", "uta")
MASCULINE = ("os", "esc", "ic", "it", "at", "ut", "iu")
# The archived miner's suffixes, feminine and masculine (folded), in order.
ARCHIVED_ENDINGS = (("a", "ata", "ita", "uta", "oasa", "easa"), ("t", "s", "c", "l", "r", "os", "at", "it", "ut"))
FEMININE_FORMS = (("it", 2, "ită"), ("at", 2, "ată"), ("ut", 2, "ută"), ("os", 2, "oasă"), ("nic", 2, "ică"), ("t", 1, "tă"))

# Kinds of domains in order of precedence, each with the expressions that show it.
DOMAINS = (
    ("forum", (r"forum\.", r"\.forum\.", "/forum", r"softpedia\.ro", r"sfatulmedicului\.ro", r"ciao\.ro", r"pcgarage\.ro", r"emag\.ro/forum", r"reddit\.com", r"quora\.com", r"stackexchange\.com", r"stackoverflow\.com")),
    ("social", (r"facebook\.com", r"fb\.com", r"twitter\.com", r"x\.com", r"instagram\.com", r"tiktok\.com", r"youtube\.com", r"linkedin\.com", r"pinterest\.com", r"tumblr\.com", r"trilulilu\.ro")),
    ("blog", (r"blogspot\.", r"wordpress\.com", r"wordpress\.org", r"medium\.com", r"substack\.com", r"blogger\.com", r"livejournal\.com", r"blog\.", r"\.blog")),
    ("qa", (r"answers\.", r"ask\.", r"raspunsuri\.", r"intrebari\.", r"discutii\.", r"comunitate\.", r"yahoo\.com/answers", r"askfm\.com")),
    ("news", (r"hotnews\.ro", r"digi24\.ro", r"mediafax\.ro", r"adevarul\.ro", r"libertatea\.ro", r"gandul\.ro", r"stirileprotv\.ro", r"observator\.tv", r"antena3\.ro", r"realitatea\.net", r"ziare\.com", r"news\.", r"bbc\.com", r"cnn\.com", r"reuters\.com")),
    ("wiki", (r"wikipedia\.org", r"wikimedia\.org", r"wiktionary\.org", r"wiki\.", r"fandom\.com")),
    ("reviews", (r"tripadvisor\.", r"booking\.com", r"yelp\.com", r"trustpilot\.com", r"amazon\.", r"emag\.ro", r"reviews\.", r"recenzii\.")),
)

# Words before which a capital doesn't begin a sentence, as names follow them.
NO_SPLIT_AFTER = (
    "la", "în", "din", "de", "pe", "cu", "și", "sau", "lui", "al", "a", "ai", "ale", "prin", "spre", "sub", "despre", "între", "peste", "lângă", "contra", "către", "după", "fără",
    "the", "and", "of", "from", "for", "with", "by", "at",
)
# Lead-ins of replies in order, and words that are no answer.
LEAD_INS = (r"[Cc]uvântul\s+lipsă\s+este\s*:\s*", r"[Tt]he\s+missing\s+word\s+is\s*:\s*", r"[Rr]ăspuns\s*:\s*")
NO_ANSWER = ("a", "de", "cu", "si", "în", "in", "la", "pe", "un", "o", "se", "nu", "ce", "ca", "și", "răspunde", "cuvântul", "cuvantul", "text", "sunt", "este")
# What parts tokens of a script with its own full stop, and frames that name a translated state, in order.
TOKEN_ENDS = "\\s।,.!?\"'()\\[\\]—–…।:;"
FELT = (r"[Ii] feel\s+(\w+)", r"[Ii] am feeling\s+(\w+)", r"[Ii]'m feeling\s+(\w+)", r"[Ii] am\s+(\w+)")

MASK = "[MASK]"


#: Two code points that no text may hold (Unicode keeps them free for such use); they mark and part what a pattern found.
MARK, PART = "\ufdd0", "\ufdd1"
_BLOCK = 64


def let(x: Column, f) -> Column:
    """f(x), where x is worked out once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """array<bigint> of the sums of the numbers up to each place.

    Blocks of 64 are summed apart, so that time stays in proportion to the array's length, but for one small step per block.
    """
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(acc: Column, n: Column) -> Column:
        at = acc["at"] + n
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    def summed(x: Column) -> Column:
        return F.aggregate(x, start, step, lambda a: a["out"])

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: summed(F.slice(x, b * _BLOCK + 1, _BLOCK)))

    def joined(parts: Column) -> Column:
        ends = summed(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda n: n + F.get(e, i - 1))))))

    return let(numbers, lambda x: F.when(F.size(x) == 0, none).when(F.size(x) <= _BLOCK, summed(x)).otherwise(let(blocks(x), joined)))


def found(x: Column, shape: str, *groups: int) -> Column:
    """array<struct<start, end, parts>>: offsets of all leftmost non-overlapping matches, in one scan; parts holds the match and the given groups.

    A group that took no part is an empty string. x must not hold MARK or PART.
    """
    shown = PART.join(f"${g}" for g in (0, *groups))
    pieces = F.split(F.regexp_replace(x, shape, f"{MARK}{shown}{MARK}"), MARK, -1)

    def placed(p: Column) -> Column:
        hits = F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1), lambda i: F.struct(F.length(F.get(p, 2 * i)).alias("gap"), F.split(F.get(p, 2 * i + 1), PART, -1).alias("parts")))
        return let(hits, lambda h: F.zip_with(h, running_sums(F.transform(h, lambda one: one["gap"] + F.length(one["parts"][0]))), lambda one, end: F.struct((end - F.length(one["parts"][0])).cast("int").alias("start"), end.cast("int").alias("end"), one["parts"].alias("parts"))))

    return let(pieces, lambda p: F.when(F.size(p) > 1, placed(p)).otherwise(F.array().cast("array<struct<start:int,end:int,parts:array<string>>>")))


def unmarked(x: Column) -> Column:
    """x without MARK and PART, which become replacement characters."""
    return F.translate(x, MARK + PART, "\ufffd\ufffd")


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def non_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*map(non_empty, columns))


def remove_diacritics(x: Column) -> Column:
    return F.translate(x, DIACRITICS, FOLDED)


def normalize(x: Column) -> Column:
    return remove_diacritics(F.lower(x))


def searchable(x: Column) -> Column:
    """As normalize, for ``found``: without MARK and PART."""
    return F.translate(F.lower(x), DIACRITICS + MARK + PART, FOLDED + "\ufffd\ufffd")


def dedup_key(sentence: Column) -> Column:
    return F.md5(F.lower(strip(sentence)).cast("binary"))


def key_of(*parts: Column) -> Column:
    """md5 over parts joined by a bar."""
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def sentences(x: Column, least: int = 10, ends: str = r"(?U)[.!?]+(?:\s+|$)") -> Column:
    """array<struct<start, end, text>>: stretches that end at marks before white space; text is stripped and longer than least.

    start and end bound the stretch before stripping, marks included.
    """

    def stretches(marks: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(marks, lambda m: m["end"]))
        ends_ = F.concat(F.transform(marks, lambda m: m["end"]), F.array(F.length(x)))
        return F.zip_with(starts, ends_, lambda a, b: F.struct(a.alias("start"), b.alias("end")))

    def cut(bodies: Column, marks: Column) -> Column:
        return F.transform(bodies, lambda body, i: strip(F.concat(body, F.coalesce(F.get(marks, i)["parts"][0], F.lit("")))))

    whole = let(F.when(x.isNotNull(), found(unmarked(x), ends)), lambda m: F.zip_with(stretches(m), cut(F.split(x, ends, -1), m), lambda w, t: F.struct(w["start"].alias("start"), w["end"].alias("end"), t.alias("text"))))
    return F.filter(whole, lambda s: F.length(s["text"]) > least)


def sentences_at_blanks(x: Column, least: int = 5) -> Column:
    """Stripped pieces between sentence ends before blanks, or lines, longer than least."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+|\n+"), lambda s: strip(s)), lambda s: F.length(s) > least)


def sentence_around(x: Column, start: Column, end: Column) -> Column:
    """The sentence that holds code points start to end (exclusive): from after the last of .!? or a line end before, to the next."""
    before = F.regexp_extract(F.substring(x, F.lit(1), start), r"[^.!?\n]*$", 0)
    after = F.regexp_extract(F.substring(x, end + 1, F.length(x)), r"^[^.!?\n]*[.!?\n]?", 0)
    return strip(F.concat(before, F.substring(x, start + 1, end - start), after))


def context_window(x: Column, start: Column, end: Column, n: int = 2, most: int = 1000) -> Column:
    """struct<before, matched, after>: the sentence (see ``sentences``) that holds a match's start, and up to n on either side, joined by spaces.

    Longer than most in all: before and after are cut, with dots, to half of what the sentence leaves; one that fits stays. Without a
    sentence, matched is the text from 200 code points before the match to 200 after it.
    """
    kind = "struct<before:string,matched:string,after:string>"
    near = F.greatest(start - 200, F.lit(0))
    alone = F.struct(F.lit("").alias("before"), strip(F.substring(x, near + 1, end + 200 - near)).alias("matched"), F.lit("").alias("after")).cast(kind)
    joined = lambda parts: F.array_join(F.transform(parts, lambda p: p["text"]), " ")

    def window(parts: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(parts, lambda p: (p["start"] <= start) & (start < p["end"])), True), F.lit(0)).cast("int")
        return let(at, lambda i: F.when(i > 0, cut(parts, i)).otherwise(alone))

    def cut(parts: Column, i: Column) -> Column:
        first = F.greatest(i - n, F.lit(1))
        whole = F.struct(joined(F.slice(parts, first, i - first)).alias("before"), F.get(parts, i - 1)["text"].alias("matched"), joined(F.slice(parts, i + 1, F.lit(n))).alias("after"))
        return let(whole, trimmed)

    def trimmed(w: Column) -> Column:
        before, after, half = F.length(w["before"]), F.length(w["after"]), F.floor((most - F.length(w["matched"])) / 2).cast("int")
        keep = half - 3
        left = F.when(keep > 0, F.right(w["before"], keep)).when(keep == 0, w["before"]).otherwise(F.substring(w["before"], 1 - keep, before))
        right = F.when(keep >= 0, F.left(w["after"], keep)).otherwise(F.left(w["after"], F.greatest(after + keep, F.lit(0))))
        short = F.struct(F.when(before > half, F.concat(F.lit("..."), left)).otherwise(w["before"]).alias("before"), w["matched"].alias("matched"), F.when(after > half, F.concat(right, F.lit("..."))).otherwise(w["after"]).alias("after"))
        return F.when(before + F.length(w["matched"]) + after > most, short.cast(kind)).otherwise(w.cast(kind))

    return F.when(x.isNotNull(), let(sentences(x), window))


def centred(x: Column, word: Column, most: int) -> Column:
    """x, if longer than most, cut to most code points around the first case-blind hit of word (the start if none), dots at cut ends."""
    at = F.greatest(F.position(F.lower(word), F.lower(x)), F.lit(1))
    left = F.greatest(F.lit(0), F.least(at - 1 + F.floor(F.length(word) / 2).cast("int") - most // 2, F.length(x) - most))
    cut = F.concat(F.when(left > 0, "...").otherwise(""), F.substring(x, left + 1, F.lit(most)), F.when(left + most < F.length(x), "...").otherwise(""))
    return F.when(F.length(x) > most, cut).otherwise(x)


def window_around(x: Column, part: Column, most: int = 5000, margin: int = 2400, fold: bool = False) -> Column:
    """x, if longer than most, cut to margin code points on either side of the first hit of part (of any case with fold); without one its first most."""
    at = F.position(F.lower(part), F.lower(x)) if fold else F.position(part, x)
    left = F.greatest(at - 1 - margin, F.lit(0))
    cut = F.substring(x, left + 1, at - 1 + F.length(part) + margin - left)
    return F.when(F.length(x) <= most, x).when(at > 0, cut).otherwise(F.left(x, F.lit(most)))


def prompt_context(x: Column, sentence: Column, most: int = 1200, margin: int = 500) -> Column:
    """What a model that validates a match gets to see of a text: all of it up to most code points, else margin on either side of the sentence."""
    return window_around(x, sentence, most, margin)


def original_word(x: Column, start: Column, normal: Column, reach: int = 50) -> Column:
    """The first word within reach of a match's start whose normal form is normal; normal itself if there is none.

    Words that reach across an edge of that stretch are left out: what lies within of them is no word.
    """
    low = F.greatest(start - reach, F.lit(0))
    wide = F.substring(x, F.greatest(low, F.lit(1)), start + reach + 2 - F.greatest(low, F.lit(1)))  # and a code point on either side, if there is one
    head = F.when(low > 0, F.regexp_replace(wide, r"(?U)^\w+", "")).otherwise(wide)
    near = F.when(F.length(x) > start + reach, F.regexp_replace(head, r"(?U)\w+$", "")).otherwise(head)
    return F.coalesce(F.get(F.filter(F.regexp_extract_all(near, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: normalize(w) == normal), F.lit(0)), normal)


def infer_gender(word: Column, feminine: tuple[str, ...] = FEMININE, masculine: tuple[str, ...] = MASCULINE) -> Column:
    """f, m or null by the folded word's end; a final consonant is m."""
    w = normalize(word)
    ends = lambda suffixes: F.reduce(F.array(*[F.endswith(w, F.lit(s)) for s in suffixes]), F.lit(False), lambda a, b: a | b)
    return F.when(ends(feminine), "f").when(ends(masculine), "m").when((F.length(w) > 0) & ~w.rlike("[aeiou]$"), "m")


def feminine_form(lemma: Column) -> Column:
    """The first suffix rewrite that fits, else null."""
    out = None
    for old, cut, new in FEMININE_FORMS:
        made = F.concat(F.substring(lemma, F.lit(1), F.length(lemma) - cut), F.lit(new))
        out = F.when(F.endswith(lemma, F.lit(old)), made) if out is None else out.when(F.endswith(lemma, F.lit(old)), made)
    return out


def domain_kind(domain: Column, url: Column | None = None) -> Column:
    """The first kind of DOMAINS of which any expression is found in the lower-case domain and url; else other."""
    x = F.lower(F.concat_ws(" ", domain, url) if url is not None else domain)
    out = None
    for kind, shapes in DOMAINS:
        hit = x.rlike("|".join(shapes))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def wrap_first(x: Column, word: Column, left: str, right: str) -> Column:
    """The first case-blind literal hit of word between left and right; x itself without a hit."""
    at = F.position(F.lower(word), F.lower(x))
    hit = F.concat(F.substring(x, F.lit(1), at - 1), F.lit(left), F.substring(x, at, F.length(word)), F.lit(right), F.substring(x, at + F.length(word), F.length(x)))
    return F.when((at > 0) & (F.length(word) > 0), hit).otherwise(x)


def mask_span(x: Column, start: Column, end: Column, mask: str = MASK) -> Column:
    return F.concat(F.substring(x, F.lit(1), start), F.lit(mask), F.substring(x, end + 1, F.length(x)))


def mask_word(x: Column, word: Column, mask: str = MASK) -> Column:
    """The first whole-word, case-blind hit of word replaced by mask; null without one."""
    gaps = F.split(F.lower(x), F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.lower(word), F.lit(r"\E(?!\w)")), 2)
    start = F.length(gaps[0])
    return F.when(F.size(gaps) > 1, mask_span(x, start, start + F.length(word), mask))


def token_with(x: Column, stem: Column) -> Column:
    """The first token (see TOKEN_ENDS) that holds stem; null without one."""
    token = F.regexp_substr(x, F.concat(F.lit(rf"(?U)[^{TOKEN_ENDS}]*\Q"), stem, F.lit(rf"\E[^{TOKEN_ENDS}]*")))
    return F.when((F.length(token) > 0) & (F.length(stem) > 0), token)


def mask_token_with(x: Column, stem: Column, mask: str = MASK) -> Column:
    """The first token that holds stem replaced by mask; null without one."""
    token = token_with(x, stem)
    at = F.position(token, x)
    return mask_span(x, at - 1, at - 1 + F.length(token), mask)


def centred_on_mask(x: Column, most: int = 3000, mask: str = MASK) -> Column:
    return centred(x, F.lit(mask), most)


def escape_non_ascii(x: Column) -> Column:
    """Each code point above 127 as a decimal character reference."""
    return F.array_join(F.transform(F.split(x, ""), lambda c: F.when(F.ascii(c) > 127, F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c)), "")


def normalize_prediction(x: Column) -> Column:
    return strip(F.regexp_replace(normalize(x), r"(?U)[^\w\s]", ""))


def parse_score(x: Column) -> Column:
    """A reply that is one digit 0 to 3, else the first such digit in it, else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(x, "[0-3]", 0), F.lit("")), F.lit("9")).cast("int")


def parse_single_word(x: Column) -> Column:
    """The one word that a wordy reply means, as written there: without thought blocks, bold, blanks to fill, lead-ins, choices and numbers.

    The first word of two or more characters that may be an answer; else the first such word at all; else what the reply begins with.
    """
    y = strip(F.regexp_replace(strip(x), r"(?s)<think>.*?</think>", ""))
    y = strip(F.regexp_replace(F.replace(y, F.lit("**"), F.lit("")), r"(?U)^[_\s.]+", ""))
    led = y
    for shape in reversed(LEAD_INS):
        led = F.when(y.rlike(rf"(?U){shape}"), strip(F.get(F.split(y, rf"(?U){shape}", 2), F.lit(1)))).otherwise(led)
    for shape in (r"(?U)^[A-D][):.]\s*(\S+)", r"(?U)^\d+[).]\s*(\S+)"):
        led = F.when(led.rlike(shape), F.regexp_extract(led, shape, 1)).otherwise(led)
    plain = strip(F.btrim(led, F.lit("\"'`*_")))
    words = F.transform(F.split(plain, r"(?U)[\s,;.!?\n()+]+"), lambda w: F.btrim(w, F.lit("\"'`*_()[]{}:")))
    some = lambda ws: F.filter(ws, lambda w: (F.length(w) >= 2) & ~F.startswith(w, F.lit("<")))
    return F.when(x.isNotNull(), let(words, lambda ws: F.coalesce(F.get(F.filter(some(ws), lambda w: ~F.lower(w).isin(*NO_ANSWER)), F.lit(0)), F.get(some(ws), F.lit(0)), F.get(ws, F.lit(0)))))


def felt_word(translated: Column, alone: Column, word: Column) -> Column:
    """A translated state: the word that the first frame of FELT finds in a translated sentence, else the first of the translated word, else word."""
    framed = F.coalesce(*[non_empty(F.regexp_extract(translated, rf"(?U){shape}", 1)) for shape in FELT])
    return F.coalesce(F.lower(framed), F.lower(non_empty(F.get(F.split(strip(alone), r"(?U)\s+"), F.lit(0)))), word)


def comma_letters(x: Column) -> Column:
    """Letters with a cedilla as those with a comma below."""
    return F.translate(x, "şţŞŢ", "șțȘȚ")


def listed(x: Column) -> Column:
    """JSON that is a string or an array of strings, as an array; plain text counts as a string."""
    many = F.startswith(F.trim(x), F.lit("["))
    return F.when(many, F.from_json(x, "array<string>")).when(x.isNotNull(), F.array(F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v"), x)))


def json_number(x: Column, field: str) -> Column:
    """A field of a JSON object as a number; null if it isn't one."""
    return F.get_json_object(x, f"$.{field}").try_cast("double")


def supervision_target(labels: Column) -> Column:
    return F.array_join(labels, " ")


def caption_sentences(x: Column) -> Column:
    """Captions cut at speaker marks, at #tags#, and between a small letter, comma or question mark and a capital."""
    cut = F.split(x, r"(?U)\s*>>\s*|\s*#[^#]*#\s*|(?<=[\p{Ll},?])\s+(?=\p{Lu})")
    return F.filter(F.transform(cut, lambda s: strip(s)), lambda s: s != "")


def _closed(x: Column) -> Column:
    """x with a period at its end, unless it ends in .!? already."""
    return F.when(F.rtrim(x).rlike(r"[.?!]$"), x).otherwise(F.concat(F.rtrim(x), F.lit(".")))


def add_periods(x: Column, keep: tuple[str, ...] = NO_SPLIT_AFTER) -> Column:
    """A period after a word that begins small if the next begins with a capital, but for the words of keep and ended ones; and at the end.

    White space becomes single spaces; a text without words stays as it is.
    """

    def one(words: Column, w: Column, i: Column) -> Column:
        plain = w.rlike(r"^\p{Ll}") & ~F.lower(w).rlike(r"[.?!]$") & ~F.rtrim(F.lower(w), F.lit(".,!?")).isin(*keep)
        return F.when(plain & F.get(words, i + 1).rlike(r"^\p{Lu}"), F.concat(F.rtrim(w, F.lit("., ")), F.lit("."))).otherwise(w)

    made = let(F.split(strip(x), r"(?U)\s+"), lambda words: F.array_join(F.transform(words, lambda w, i: one(words, w, i)), " "))
    return F.when(strip(x) == "", x).otherwise(_closed(made))


def light_caption(x: Column, seed: Column, keep: tuple[str, ...] = NO_SPLIT_AFTER) -> Column:
    """A caption as sentences: without #tags#; of several speakers' parts the first with seed (else the first); with periods added; without a
    first sentence that begins small and doesn't hold seed, if there are others; ended by a period."""
    clean = strip(F.regexp_replace(F.regexp_replace(x, r"#[^#]+#", " "), r"(?U)\s+", " "))
    held = lambda t: F.contains(F.lower(t), F.lower(seed))
    parts = F.filter(F.transform(F.split(clean, ">>"), lambda p: strip(p)), lambda p: p != "")
    own = F.when(F.contains(clean, F.lit(">>")), let(parts, lambda ps: F.coalesce(F.get(F.filter(ps, held), F.lit(0)), F.get(ps, F.lit(0)), clean))).otherwise(clean)

    def cut(ended: Column) -> Column:
        kept = lambda ss: F.filter(ss, lambda t, i: (i > 0) | t.rlike(r"^\p{Lu}") | held(t))
        found = F.filter(F.transform(F.split(ended, r"(?U)(?<=\.)\s+"), lambda t: strip(t)), lambda t: t != "")
        return let(kept(found), lambda ss: F.when(F.size(ss) == 0, ended).otherwise(let(F.array_join(ss, " "), lambda t: F.when(t.rlike(r"[.?!]$"), t).otherwise(F.concat(t, F.lit("."))))))

    return let(add_periods(own, keep), cut)


def match_position(parts: Column, seed: Column, triggers: tuple[str, ...]) -> Column:
    """The place (from 1) of the first part with seed and a trigger, else with seed, else the middle one."""
    low = F.transform(parts, lambda p: normalize(p))
    with_seed = F.transform(low, lambda p: F.contains(p, normalize(seed)))
    both = F.transform(low, lambda p: F.contains(p, normalize(seed)) & p.rlike("|".join(triggers)))
    return F.coalesce(F.nullif(F.array_position(both, True), F.lit(0)), F.nullif(F.array_position(with_seed, True), F.lit(0)), F.floor(F.size(parts) / 2) + 1)


def first_person_run(parts: Column, persons: Column, at: Column) -> Column:
    """The parts around place at up to the nearest ones, on either side, in the second or third person, joined by spaces."""
    barrier = lambda keep: F.filter(F.transform(persons, lambda p, i: F.when(p.isin(2, 3), i + 1)), keep)
    low = F.coalesce(F.array_max(barrier(lambda i: i < at)), F.lit(0))
    high = F.coalesce(F.array_min(barrier(lambda i: i > at)), F.size(parts) + 1)
    return F.array_join(F.slice(parts, (low + 1).cast("int"), (high - low - 1).cast("int")), " ")


def video_id(url: Column) -> Column:
    first = lambda shape: non_empty(F.regexp_extract(url, shape, 1))
    return F.coalesce(first(r"[?&]v=([A-Za-z0-9_-]{11})"), first(r"youtu\.be/([A-Za-z0-9_-]{11})"), first(r"/(?:embed|shorts|v)/([A-Za-z0-9_-]{11})"))


def parse_views(x: Column) -> Column:
    """Digits without points and commas, times a thousand or a million for K or M; so 1.2M is 12 million."""
    flat = F.upper(F.regexp_replace(x, "[.,]", ""))
    n = F.regexp_extract(flat, r"(\d+)\s*([KM]?)", 1).try_cast("bigint")
    unit = F.regexp_extract(flat, r"(\d+)\s*([KM]?)", 2)
    return n * F.when(unit == "K", 1000).when(unit == "M", 1_000_000).otherwise(1)


def parse_duration(x: Column) -> Column:
    """Seconds of h:m:s, m:s or s; null otherwise."""
    parts = F.split(F.trim(x), ":")
    seconds = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 60 + p.try_cast("bigint"))
    return F.when(F.trim(x).rlike(r"^\d+(?::\d+){0,2}$"), seconds)


def whole_words(tokens: Column, most: int = 50) -> Column:
    """Whole words of vocabulary tokens: no ## continuation; those with a leading ▁, Ġ or blank, and letters only of two or more; marks go."""
    plain = lambda t: strip(t).rlike(r"^\p{L}{2,}$")
    kept = F.filter(tokens, lambda t: (strip(t) != "") & ~F.startswith(strip(t), F.lit("##")) & (t.rlike("^[▁Ġ ]") | plain(t)))
    return F.slice(F.transform(kept, lambda t: F.btrim(t, F.lit("▁Ġ "))), 1, most)


def literal_list(x: Column) -> Column:
    """A list literal in single or double quotes as an array; null if it doesn't parse."""
    return F.from_json(F.regexp_replace(x, r"(?<=[\[, ])'|'(?=\s*[,\]])", '"'), "array<string>")


def chat(system: Column, user: Column) -> Column:
    """array<struct<role, content>> for a chat model."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", system), turn("user", user))


def training_pair(masked: Column, target: Column, sentinel: str = "<extra_id_0>", mask: str = MASK) -> Column:
    """struct<input, target> of a sequence model: the mask swapped for its sentinel."""
    return F.struct(F.replace(masked, F.lit(mask), F.lit(sentinel)).alias("input"), F.concat(F.lit(sentinel + " "), target).alias("target"))


def baseline_clean(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)[^\p{L}\p{N}]+", " "), " +", " "))


def parse_verdict(x: Column, schema: str, fields: dict[str, str]) -> Column:
    """A struct of schema from a reply: its JSON, else that in a code fence, else its first object, else fields by expressions.

    fields: for each field an expression whose first group is its value. All null if nothing parses.
    """
    tries = [x, F.regexp_extract(x, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(x, r"(\{[^{}]*\})", 1)]
    parsed = [F.from_json(F.when(F.try_parse_json(t).isNotNull() & F.startswith(F.trim(t), F.lit("{")), t), schema) for t in tries]
    picked = [(non_empty(F.regexp_extract(x, fields[f.name], 1)) if f.name in fields else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
    return F.coalesce(*parsed, F.struct(*picked))


def affect_verdict(x: Column) -> Column:
    """struct<is_affective, confidence, reasoning> of a reply (see ``parse_verdict``); a broken one keeps what its fields show, with 0.5 as
    confidence and ``parse_error``, or tells that it failed, with its first 200 code points."""
    kind = "struct<is_affective:boolean,confidence:double,reasoning:string>"
    got = parse_verdict(strip(x), "is_affective boolean, confidence double, reasoning string", {"is_affective": r'(?i)"is_affective"\s*:\s*(true|false)', "confidence": r'"confidence"\s*:\s*([\d.]+)', "reasoning": r'"reasoning"\s*:\s*"([^"]*)"'})
    parses = lambda t: F.startswith(t, F.lit("{")) & F.try_parse_json(t).isNotNull()
    whole = parses(strip(x)) | parses(F.regexp_extract(x, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)) | parses(F.regexp_extract(x, r"(\{[^{}]*\})", 1))
    partial = lambda v: F.struct(v["is_affective"], F.coalesce(v["confidence"], F.lit(0.5)), F.coalesce(v["reasoning"], F.lit("parse_error"))).cast(kind)
    failed = F.struct(F.lit(None).cast("boolean"), F.lit(0.0), F.concat(F.lit("failed_to_parse: "), F.left(strip(x), F.lit(200)))).cast(kind)
    return let(got, lambda v: F.when(F.coalesce(whole, F.lit(False)), v.cast(kind)).when(v["is_affective"].isNotNull(), partial(v)).otherwise(failed))


def fertility(df: DataFrame, tokens: str, words: str) -> DataFrame:
    """Tokens per word over all rows of two arrays."""
    return df.agg((F.sum(F.size(tokens)) / F.sum(F.size(words))).alias("fertility"))
