import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexloom.llm import tokens

HARD = [
    "", " ", "  ", "a", " a", "a ", "a  ", "a  b", "a   b", " a\n \nb", "x \n y", "\n\n a", "tab\t \tq", "don't you'll I'd 's", "été, naïve ÉCOLE Straße", "İstanbul ΑΣ ΟΔΟΣ",
    "12 3456 7.8", "a b  c   d", "\x1c a\x1db \x85c", "<|endoftext|> <|startoftext|>", "word$$$ two%%% |||", "日本語 テスト 😀😀 é ́x", "a​b", "Ġ Ġfoo", "foo</w> </w>", "_a_ __ a_b",
]


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_cached_encoding_equals_the_library(name):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    rng = random.Random(5)
    words = [w for x in HARD for w in x.split()] + ["the", "Then", "x1", "a,b", "end.", "été.", "l'été", "it's", "99", "́"]
    texts = HARD + [rng.choice(["", " ", "\n"]) + "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", " \n", "\t", "   ", " "]) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [" ".join(texts) * 20, "one.\ntwo\nthree " * 30, "\n".join(f"line{i}" for i in range(5000)), "a\n\nb c\nd\r\ne f\x85\ng h\n\u00a0i"]
    cached = tokens.WordTokenizer(public_tokenizers.path(name))
    for _ in range(2):
        got = [np.frombuffer(x, cached.dtype).tolist() for x in cached.encode(texts)]
        want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        for text, a, b in zip(texts, got, want, strict=True):
            assert a == b, repr(text)


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_the_operators_tokenizer_equals_the_untouched_library(name):
    plain, rng = Tokenizer.from_file(public_tokenizers.path(name)), random.Random(7)
    marks = ["<|endoftext|>", "<|startoftext|>", "x<|endoftext|>y", "<|EndOfText|>", "<|endoftext", "the", "end.", "É"]
    texts = [*HARD, "a b<|endoftext|> c", "x\n <|endoftext|>", "x \n<|endoftext|>  y", *["".join(rng.choice(marks) + rng.choice(["", " ", " ", "\n", "\n ", "  "]) for _ in range(rng.randrange(12))) for _ in range(300)]]
    cached = tokens.tokenizer(name)
    for _ in range(2):
        for text, ids in zip(texts, cached.encode(texts), strict=True):
            assert np.frombuffer(ids, cached.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_the_cache_is_bounded_within_a_call_and_holds_no_long_words(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 400)
    plain, cached = Tokenizer.from_file(public_tokenizers.path(name)), tokens.WordTokenizer(public_tokenizers.path(name), special=True)
    words = ["w" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(3000)]
    texts = [" ".join(w for w in words for _ in range(4)), *["start " + "x" * 5000 + "\u65e5" * 5000] * 4, *["a " + "b" * 70 + "." * 70] * 4]
    for text, ids in zip(texts, cached.encode(texts), strict=True):
        assert np.frombuffer(ids, cached.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids
    for cache in (cached.words, cached.heads):
        assert len(cache) <= cache.most and len(cache.old) <= cache.most
        assert all(len(w) <= 64 for x in (cache, cache.old) for w in x)
    assert all(len(x) <= 64 for x in cached.ends) and cached.words.turns
