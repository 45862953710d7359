from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from placestream.llm import words as w

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbZ09 .\n\t\x00\x1cé中😀-"), max_size=20)), min_size=1, max_size=6)


def plain(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_of_columns_equal_words_of_each_text(texts):
    raw, offs = w.buffers(pa.array(texts, pa.string()))
    got = w.words(raw, offs, w.PLAIN)
    want = [plain(t) for t in texts]
    assert got.count.tolist() == [len(x) for x in want]
    assert [bytes(got.bytes[a:b]).decode() for a, b in zip(got.start, got.end)] == [x for t in want for x in t]
    each = np.concatenate([w.hash_text(t or "", w.PLAIN) for t in texts])
    assert (got.hashes() == each).all()
    spaced = w.words(raw, offs, w.SPACED_NUL)
    assert spaced.count.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_slices_cover_all_rows_and_keep_long_texts_whole():
    texts = ["a" * n for n in (5, 0, 100, 3, 3, 3)]
    raw, offs = w.buffers(pa.array(texts).slice(1))
    parts = list(w.slices(raw, offs, 8))
    assert sum(len(o) - 1 for _, _, o in parts) == 5
    assert b"".join(bytes(r) for _, r, _ in parts).decode() == "".join(texts[1:])


def test_shingles_stay_in_their_row():
    h = np.arange(7, dtype=np.uint64)
    got, at = w.shingles(h, np.array([0, 0, 0, 1, 1, 1, 1]), 3)
    assert at.tolist() == [0, 3, 4]
    assert len(set(got.tolist())) == 3
