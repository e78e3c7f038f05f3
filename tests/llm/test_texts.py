"""The byte-array helpers against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from casewise.llm import texts

PIECES = st.sampled_from(["a", "B", "ab", " ", "\n", "\t", "\x0b", "é", "日本", "🙂", ".", "the", " ", ""])
TEXTS = st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=30).map("".join)), min_size=1, max_size=6)


def words(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", low)


def plain_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_shingle_sets(rows):
    data, offsets = texts.strings(pa.array(rows, pa.string()))
    values, at = texts.shingle_sets(data, offsets)
    sets = [set(values[at[k] : at[k + 1]].tolist()) for k in range(len(rows))]
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in rows]
    for x, s in zip(rows, sets, strict=True):
        for y, t in zip(rows, sets, strict=True):
            assert len(s & t) == len(plain_set(x) & plain_set(y))


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_codepoints(rows):
    data, _ = texts.strings(pa.array(rows, pa.string()))
    code, at = texts.codepoints(data)
    whole = "".join(t or "" for t in rows)
    assert code.tolist() == [ord(c) for c in whole]
    assert len(at) == len(whole)


def test_slices_keep_texts_whole():
    rows = ["x" * 10, "", "y" * 50, None, "z"]
    got = []
    for first, end, data, offsets in texts.slices(pa.array(rows), 16):
        assert len(offsets) == end - first + 1
        got += [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [t or "" for t in rows]


def test_equal_spans_hash_alike():
    data = np.frombuffer(b"abc--abc-abd", np.uint8)
    a, b, c = texts.span_hashes(data, np.array([0, 5, 9]), np.array([3, 8, 12]))
    assert a == b != c
