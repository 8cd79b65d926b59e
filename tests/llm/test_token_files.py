import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexloom.llm import token_files


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 700), max_size=1500), st.data())
def test_any_token_can_be_read(ids, data):
    reader = token_files.Reader(token_files.encode(np.array(ids, np.uint32)))
    assert reader.size == len(ids) and reader.slice(0, len(ids)).tolist() == ids
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert reader.slice(a, b).tolist() == ids[a:b]
    if a < len(ids):
        assert reader.token(a) == ids[a]


def test_round_trip(docs_of):
    rows = [(i * 7919 % 1009, "Words of many kinds, número 12. " * (i % 30)) for i in range(200)] + [(2000, None), (2001, ""), (-5, "first"), (2002, "very long " * 40_000)]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    files = token_files.write_token_files(docs_of(rows, extra=True).repartition(6), file_tokens=3000)
    got = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, (i, t) in zip(got, sorted((x[0], x[1]) for x in rows), strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_texts_are_indexed_in_the_file():
    data = token_files.encode(np.arange(1000, 1010, dtype=np.uint32), [3, 0, 7])
    reader = token_files.Reader(data)
    assert reader.ends.tolist() == [3, 3, 10] and reader.slice(3, 10).tolist() == list(range(1003, 1010))
    assert token_files.Reader(token_files.encode(np.zeros(0, np.uint32), [])).size == 0
    with pytest.raises(ValueError, match="damaged"):
        token_files.Reader(data[:11] + b"\x0b" + data[12:])
    with pytest.raises(ValueError, match="not a token file"):
        token_files.Reader(b"DAC1" + data[4:])


def test_nulls_ties_and_nothing(docs_of):
    assert token_files.read_token_files(token_files.write_token_files(docs_of([]))).collect() == []
    got = token_files.read_token_files(token_files.write_token_files(docs_of([(3, "x"), (3, "y z"), (None, "n")]))).collect()
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 3, 3] and got[0].start == 0 and got[1].start == got[0].n_tokens
