import re

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T

C, L = F.col, F.lit


@pytest.fixture(scope="module")
def run(spark):
    """The value of a column made from x."""

    def one(make, x, kind="string"):
        return spark.createDataFrame([(x,)], f"x {kind}").select(make(C("x")).alias("y")).first().y

    return one


def test_normal_forms(run):
    assert run(T.normalize, "MĂ SIMT Șţâî") == "ma simt stai"
    assert run(T.strip, "\t a b \n ") == "a b"
    assert run(T.dedup_key, " Ab\n") == run(T.dedup_key, "ab")
    assert run(T.normalize_prediction, " Fericit!? ") == "fericit" and run(T.normalize, None) is None
    assert run(lambda x: T.first_non_empty(x, L("b")), "") == "b"
    assert run(T.escape_non_ascii, "aăb") == "a&#259;b"
    assert run(T.baseline_clean, "Ana, are 2  mere!") == "ana are 2 mere"


def test_sentences(run):
    got = run(T.sentences, "Da. Mă simt foarte bine azi! Ok")
    assert [s.text for s in got] == ["Mă simt foarte bine azi!"] and (got[0].start, got[0].end) == (4, 29)
    assert run(T.sentences_at_blanks, "Abc def. Ghi jkl!\nx\nlong line") == ["Abc def.", "Ghi jkl!", "long line"]
    text = "Unu. Eu mă simt bine azi! Doi"
    assert run(lambda x: T.sentence_around(x, L(8), L(20)), text) == "Eu mă simt bine azi!"


def plain_window(text, start, end, n=2, most=1000):
    """The same rules in plain Python."""
    found, at = [], 0
    for m in re.finditer(r"[.!?]+(?:\s+|$)", text):
        found.append((at, m.end(), text[at : m.end()].strip()))
        at = m.end()
    found = [s for s in [*found, (at, len(text), text[at:].strip())] if len(s[2]) > 10]
    here = next((i for i, s in enumerate(found) if s[0] <= start < s[1]), None)
    if here is None:
        return "", text[max(0, start - 200) : end + 200].strip(), ""
    before, after = (" ".join(s[2] for s in x) for x in (found[max(0, here - n) : here], found[here + 1 : here + n + 1]))
    if len(before) + len(found[here][2]) + len(after) > most:
        half = (most - len(found[here][2])) // 2
        before = "..." + before[-(half - 3) :] if len(before) > half else before
        after = after[: half - 3] + "..." if len(after) > half else after
    return before, found[here][2], after


def test_context_windows(spark):
    text = "Unu doi trei patru. Cinci! Mă simt foarte bine azi? Da. Șase șapte opt nouă... Zece unsprezece doisprezece. Fără punct la sfârșit"
    rows = [(text, at, at + 7, most) for at in range(0, len(text), 5) for most in (1000, 90, 60, 40, 30, 29, 28, 27, 20, 5)] + [("Scurt.", 0, 3, 10), ("", 0, 0, 10), ("x" * 700, 300, 310, 20)]
    df = spark.createDataFrame(rows, "t string, a int, b int, m int")
    for most in {r[3] for r in rows}:
        for r in df.filter(C("m") == most).select("t", "a", "b", T.context_window(C("t"), C("a"), C("b"), 2, most).alias("w")).collect():
            assert tuple(r.w) == plain_window(r.t, r.a, r.b, 2, most), (r.a, most)
    assert df.limit(1).select(T.context_window(L(None).cast("string"), L(0), L(1)).alias("w")).first().w is None


def test_offsets_and_running_sums(spark, run):
    for n in (0, 1, 63, 64, 65, 128, 129, 1000):
        assert run(lambda x: T.running_sums(F.sequence(L(1), x)) if n else T.running_sums(F.array().cast("array<int>")), n, "int") == [i * (i + 1) // 2 for i in range(1, n + 1)]
    got = run(lambda x: T.found(x, r"(\d)(x)?", 1, 2), "a1x😀2 3")
    assert [(h.start, h.end, h.parts) for h in got] == [(1, 3, ["1x", "1", "x"]), (4, 5, ["2", "2", ""]), (6, 7, ["3", "3", ""])]
    assert run(lambda x: T.found(x, "z"), "abc") == [] and run(T.unmarked, "a\ufdd0b") == "a\ufffdb"
    many = run(T.sentences, "Aici sunt multe. " * 5000)
    assert len(many) == 5000 and (many[-1].start, many[-1].end) == (17 * 4999, 85_000)


def test_words(run):
    assert [run(T.infer_gender, w) for w in ("fericită", "fericit", "calm", "bine")] == ["f", "m", "m", None]
    assert [run(T.feminine_form, w) for w in ("fericit", "curios", "puternic", "trist", "bun")] == ["fericită", "curioasă", "puternică", "tristă", None]
    assert run(lambda x: T.original_word(x, L(8), L("fericita")), "Mă simt Fericită azi") == "Fericită"
    for before in (42, 43, 44, 45, 46, 47, 48):  # what an edge cuts off is no word
        x = f"Bathe {'.' * before}The end"
        assert run(lambda y: T.original_word(y, L(x.index("The")), L("the")), x) == "The"
    assert run(lambda x: T.original_word(x, L(0), L("the")), f"The{'.' * 44}thesis") == "The" and run(lambda x: T.original_word(x, L(0), L("the")), f"Zhe{'.' * 44}thesis") == "the"
    assert run(lambda x: T.original_word(x, L(0), L("the")), "The") == "The" and run(lambda x: T.original_word(x, L(50), L("the")), f"{'.' * 50}The") == "The"
    assert run(lambda x: T.wrap_first(x, L("BINE"), "<", ">"), "Sunt bine, bine") == "Sunt <bine>, bine"
    assert run(lambda x: T.mask_word(x, L("bine")), "Binefăcut, Bine!") == "Binefăcut, [MASK]!" and run(lambda x: T.mask_word(x, L("rau")), "bine") is None
    assert run(lambda x: T.mask_token_with(x, L("feric")), "El e (nefericit).") == "El e ([MASK])."
    assert run(T.whole_words, ["##x", "▁bun", "rău", "▁.", "▁calm"], "array<string>") == ["bun", "rău", ".", "calm"]
    assert run(T.whole_words, ["Ġbun", "trist", "x", "9", " ok ", "", None], "array<string>") == ["bun", "trist", "ok"]
    assert run(lambda x: T.mask_token_with(x, L("दुख")), "वह दुखी। है") == "वह [MASK]। है" and run(lambda x: T.mask_token_with(x, L("a")), "x—bac…d") == "x—[MASK]…d"
    assert run(T.domain_kind, "www.reddit.com") == "forum" and run(T.domain_kind, "news.ro") == "news" and run(T.domain_kind, "example.ro") == "other"


def test_replies(run):
    assert [run(T.parse_score, x) for x in ("2", " Scor: 3.", "nu", "9", None)] == [2, 3, None, None, None]
    assert run(T.parse_single_word, "<think>hmm</think>**Răspuns:** a) Fericit.") == "Fericit"
    replies = {"...": "", "sunt trist": "trist", "Cu Teamă": "Teamă", "A) bucurie\nB) frică": "bucurie", "1. calm\n2. trist": "calm", "The missing word is: \"happy\"!": "happy", "**Cuvântul lipsă este:** de": "de", "___ furios": "furios", "<b> nu": "nu", "`ok`": "ok", "o": "o"}
    assert {x: run(T.parse_single_word, x) for x in replies} == replies and run(T.parse_single_word, None) is None
    assert [run(lambda x: T.felt_word(x, L(" Sad one"), L("trist")), x) for x in ("Now I feel Blue.", "I'm feeling low", "i am Glad", "none", None)] == ["blue", "low", "glad", "sad", "sad"]
    assert run(T.comma_letters, "şţŞŢs") == "șțȘȚs" and run(T.supervision_target, ["a", "b"], "array<string>") == "a b"
    assert [run(T.listed, x) for x in ('["joy", "fear"]', '"joy"', "joy", None)] == [["joy", "fear"], ["joy"], ["joy"], None]
    assert run(T.literal_list, "['trist', 'calm']") == ["trist", "calm"] and run(T.literal_list, "nope") is None
    assert [m.role for m in run(lambda x: T.chat(L("s"), x), "u")] == ["system", "user"]
    assert tuple(run(lambda x: T.training_pair(x, L("bine")), "Sunt [MASK].")) == ("Sunt <extra_id_0>.", "<extra_id_0> bine")


def test_captions(run):
    assert run(T.caption_sentences, "salut >> ce faci? Bine #muzică# da") == ["salut", "ce faci?", "Bine", "da"]
    periods = {"mă simt bine Apoi am plecat la Iași": "mă simt bine. Apoi am plecat la Iași.", "vine, Ana": "vine. Ana.", "Duke Denis  a venit! Bine": "Duke Denis a venit! Bine.", "cu, Ana": "cu, Ana.", "": "", " ": " ", "gata?": "gata?"}
    assert {x: run(T.add_periods, x) for x in periods} == periods
    assert run(lambda x: T.add_periods(x, ()), "am plecat la Iași") == "am plecat la. Iași."
    light = {"ceva ce nu Sunt bine >> altul #x#": "Sunt bine.", "e bine azi Apoi altul": "e bine azi. Apoi altul.", ">> unu >> doi": "unu.", "fără început": "fără început.", "#a# Bine? Da": "Bine? Da."}
    assert {x: run(lambda x: T.light_caption(x, L("bine")), x) for x in light} == light
    parts = F.array(L("nimic"), L("sunt bine"), L("bine"))
    assert run(lambda x: T.match_position(parts, L("bine"), ("sunt",)), "") == 2 and run(lambda x: T.match_position(parts, L("zzz"), ("q",)), "") == 2
    people = F.array(*[L(p) for p in (2, 1, 1, 3)])
    assert run(lambda x: T.first_person_run(F.array(*map(L, "abcd")), people, L(2)), "") == "b c"


def test_videos(run):
    assert run(T.video_id, "https://youtu.be/abcdefghijk?t=3") == "abcdefghijk" and run(T.video_id, "x") is None
    assert [run(T.parse_views, x) for x in ("1.2M views", "3K", "1,234")] == [12_000_000, 3000, 1234]
    assert [run(T.parse_duration, x) for x in ("1:02:03", "2:03", "45", "x")] == [3723, 123, 45, None]
    assert run(lambda x: T.centred(x, L("mid"), 9), "aaaaaaaaaamidbbbbbbbbbb") == "...aaamidbbb..."


def test_verdicts(run):
    make = lambda x: T.parse_verdict(x, "score int, why string", {"score": r'score\D{0,3}(\d)', "why": r'why"?:\s*"([^"]*)'})
    assert tuple(run(make, '{"score": 2, "why": "a"}')) == (2, "a")
    assert tuple(run(make, 'Sure:\n```json\n{"score": 1}\n```')) == (1, None)
    assert tuple(run(make, 'I say {"score": 3, "why": "b"} so')) == (3, "b")
    assert tuple(run(make, "score: 2, broken {")) == (2, None) and tuple(run(make, "none")) == (None, None)
    assert tuple(run(make, 'x {"score": 1} y {"score": 2}')) == (1, None)
    verdicts = {'{"is_affective": true, "confidence": 0.9, "reasoning": "r"}': (True, 0.9, "r"), 'so: "is_affective": FALSE, "confidence": 0.25, x': (False, 0.25, "parse_error"), '"is_affective" : true': (True, 0.5, "parse_error"), " nothing ": (None, 0.0, "failed_to_parse: nothing"), '{"confidence": 1}': (None, 1.0, None)}
    assert {x: tuple(run(T.affect_verdict, x)) for x in verdicts} == verdicts


def test_windows_around(run):
    text = "a" * 30 + "Xy" + "b" * 30
    cut = lambda part, fold=False: run(lambda x: T.window_around(x, L(part), 40, 5, fold), text)
    assert cut("Xy") == "aaaaaXybbbbb" and cut("xy") == text[:40] and cut("xy", True) == "aaaaaXybbbbb" and cut("zz") == text[:40]
    assert run(lambda x: T.window_around(x, L("aa"), 40, 5), text) == "aaaaaaa" and run(lambda x: T.window_around(x, L("q"), 99, 5), text) == text
