import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pledgetrace.llm import words as w
from pledgetrace.llm.tables import text_bytes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é\t\n.-9ß", max_size=40)), max_size=8))
def test_words_are_those_of_a_plain_split(texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    first, starts, ends, h, head = w.words(data, offsets, w.NOT_ALNUM, (2,))
    raw = data.tobytes().lower()
    got = [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
    assert got == [re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower()) for t in texts]
    flat = [x for row in got for x in row]
    assert len(set(h.tolist())) == len(set(flat)) and len(set(zip(flat, h.tolist()))) == len(set(flat))
    assert len(set(zip([x[:2] for x in flat], head.tolist()))) == len({x[:2] for x in flat})


def test_slices_do_not_change_hashes(monkeypatch):
    data, offsets = text_bytes(pa.array(["some words in a row " * 300, "x" * 5000, "", "tail"]))
    whole = w.words(data, offsets)
    monkeypatch.setattr(w, "SLICE", 64)
    for a, b in zip(whole, w.words(data, offsets)):
        assert np.array_equal(a, b)


def test_shingles_stay_within_texts():
    data, offsets = text_bytes(pa.array(["a b c d", "b c", None, "a b c"]))
    first, *_, h = w.words(data, offsets)
    sh, bounds = w.shingles(first, h, 3)
    assert bounds.tolist() == [0, 2, 2, 2, 3] and sh[0] == sh[2] != sh[1]


def test_lookup():
    keys = np.array([5, 9, 2**63 + 1], np.uint64)
    at, place = w.Lookup(keys).hits(np.array([9, 1, 5, 2**63 + 1, 2**63], np.uint64))
    assert at.tolist() == [0, 2, 3] and place.tolist() == [1, 0, 2]
    assert w.Lookup(keys[:0]).hits(keys)[0].tolist() == []
