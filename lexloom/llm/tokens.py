"""Tokenising whole texts with the tokenizers library, word by word through a bounded cache.

Both vocabularies cut text at white space before they merge, so the ids of a text are those of its words in a row. Words repeat, so each
Python worker keeps the ids of those it has met. A new word that is Latin letters, with or without punctuation after them, goes
straight to the vocabulary's merges; any other goes through the library's whole pipeline. Texts for which a cut at spaces could
change the ids, and those that hold a special token's string, are encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

#: Words in each of the cache's two generations; of words without a space before them, a quarter. When the younger is full, it becomes the older, and the older goes. Bounds memory, never results.
CACHE_WORDS = 450_000
#: Code points of a word that is kept, at most: longer runs without a space seldom come again, and one may be a whole text.
LONGEST = 64
#: Counts of words met: only words that come so many times are worth a place in the cache.
MARKS, MEETINGS = 1 << 22, 3
#: Turns of the cache after which marks are taken back.
TURNS = 4
PUNCTUATION = ".,;:!?$&%*#|"

_blank_runs = re.compile(r"\s (?:\s|\Z)")
_separators = re.compile(r"[\x1c-\x1f]")
_loaded: dict[str, WordTokenizer] = {}


def _byte_table() -> dict[int, str]:
    """The character that byte-level vocabularies write for a byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Words(dict):
    """Ids of words, learnt when missed. Holds words met before, in two generations of at most so many words, none of them long."""

    def __init__(self, owner: WordTokenizer, lead: str, most: int):
        super().__init__()
        self.most = most
        self.owner, self.lead, self.old, self.met, self.turns = owner, lead, {}, bytearray(MARKS), 0

    def keep(self, w: str, ids: bytes) -> None:
        """Makes room first if the younger generation is full, in the middle of a text, too."""
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
            self.turns += 1
            if self.turns % TURNS == 0:
                self.met = bytearray(MARKS)
        self[w] = ids

    def forget(self) -> None:
        self.clear()
        self.old, self.met = {}, bytearray(MARKS)

    def __missing__(self, w: str) -> bytes:
        ids = self.old.get(w)
        if ids is not None:
            self.keep(w, ids)
            return ids
        owner = self.owner
        if "\n" in w and not owner.word_ends:
            first, *more = parts = w.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in parts):  # a line end between two words is a piece of its own
                return self[first] + b"".join([owner.line + owner.heads[x] for x in more])
        stem = w.rstrip(PUNCTUATION)
        piece = owner.plain(stem)
        if piece is None:
            ids = owner.whole([" " + w if self.lead else w])[0]
        else:
            ids = self.get(stem) or owner.merged(piece, self.lead)
            if len(stem) < len(w):
                ids += owner.end(w[len(stem) :])
        if len(w) <= LONGEST:
            mark = hash(w) & (MARKS - 1)
            if self.met[mark] >= MEETINGS - 1:
                self.keep(w, ids)
            else:
                self.met[mark] += 1
        return ids


class WordTokenizer:
    """encode(texts) gives the ids of each text, equal to the library's own, as little-endian numbers of self.dtype.

    special: a special token's string in a text is that token, as in the library's plain call; else it is ordinary text.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = self.tokenizer.get_added_tokens_decoder().values() if special else ()
        self.special = re.compile("|".join(re.escape(t.content) for t in added)) if added else None
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.word_ends = any(x.endswith("</w>") for x in vocab)
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(max(vocab.values()) + 1)]
        self.model, self.table = self.tokenizer.model, _byte_table()
        self.line = b"" if self.word_ends else self.whole(["\n"])[0]
        self.words, self.heads, self.ends = _Words(self, "" if self.word_ends else "Ġ", CACHE_WORDS), _Words(self, "", CACHE_WORDS // 4), {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, letters: str, lead: str) -> bytes:
        """The ids of one piece of the vocabulary's pattern. lead: how it writes a space before it."""
        shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.table)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(lead + shown)])

    def plain(self, letters: str) -> str | None:
        """The piece that a word of Latin letters is; None if letters isn't one."""
        if not letters.isalpha() or (not letters.isascii() and max(letters) >= "\u0250"):
            return None
        if not self.word_ends:
            return letters
        small = letters.lower()
        return small if len(small) == len(letters) else None

    def end(self, marks: str) -> bytes:
        """The ids of the punctuation that ends a word."""
        if len(marks) > LONGEST:
            return self.merged(marks, "")
        if marks not in self.ends:
            if len(self.ends) > 10_000:
                self.ends.clear()
            self.ends[marks] = self.merged(marks, "")
        return self.ends[marks]

    def encode(self, texts: list[str]) -> list[bytes]:
        odd, get, out = _separators if self.word_ends else _blank_runs, self.words.__getitem__, []
        special = self.special
        for text in texts:
            if odd.search(text) or (special and special.search(text)):
                out += self.whole([text])
            elif self.word_ends:
                out.append(b"".join(map(get, text.split())))
            else:
                words = text.split(" ")
                out.append(self.heads[words[0]] + b"".join(map(get, islice(words, 1, None))))
        return out


def tokenizer(name: str) -> WordTokenizer:
    """The worker's own tokenizer for a vocabulary file: a name of public_tokenizers or a path."""
    if name not in _loaded:
        path = name
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _loaded[name] = WordTokenizer(path, special=True)
    return _loaded[name]


def forget() -> None:
    """Empties this worker's caches, for stages that don't encode."""
    for t in _loaded.values():
        t.words.forget()
        t.heads.forget()
        t.ends.clear()
