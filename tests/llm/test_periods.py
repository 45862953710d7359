"""Periodic runs against brute force: every stretch of every period, texts by hand, awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from placestream.llm import periods

from .cases import awkward, nothing


def slow_runs(words: list) -> list[tuple[int, int, int]]:
    """By definition: for every period, stretches of equal words that far apart; of one stretch the least period."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // periods.LEAST_TURNS + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(periods.LEAST_LENGTH, periods.LEAST_TURNS * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def fast_runs(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    ends = np.cumsum([len(t) for t in texts])
    runs = periods.runs_of(np.array([w for t in texts for w in t], np.int64), ends)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs.tolist():
        k = int(np.searchsorted(ends, start, "right"))
        out[k].append((start - int(ends[k]) + len(texts[k]), length, period))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_runs_are_those_of_the_definition(texts):
    assert fast_runs(texts) == [slow_runs(t) for t in texts]


def test_runs_within_runs_and_long_periods():
    rng = random.Random(5)
    for _ in range(60):
        text: list[int] = []
        while len(text) < 300:
            unit = [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
            text += (unit * rng.randrange(1, 9))[: rng.randrange(1, 150)]
        assert fast_runs([text]) == [slow_runs(text)]
    inner = [1, 1, 1, 1, 1, 1, 2]  # a run of ones in every turn of a longer run
    assert fast_runs([inner * 5]) == [slow_runs(inner * 5)] != [[]]


def test_one_word_many_times_takes_no_square():
    n = 60_000
    assert fast_runs([[7] * n]) == [[(0, n, 1)]]
    assert fast_runs([[1, 2, 3] * (n // 3)]) == [[(0, n, 3)]]


def slow_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def got(rows):
    return sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows), key=str)


def test_query_is_brute_force_on_short_documents(spark, data_dir, tmp_path):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    docs = docs.unionByName(awkward(spark).filter("n_chars is null or n_chars < 1000").select(*docs.columns))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    ours = got(periods.op11_periodic_runs(spark, f"file://{tmp_path}").collect())
    expected = sorted((slow_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str)
    assert ours == expected
    assert sum(r[1] > 0 for r in expected) > 5


def test_texts_keep_what_repetition_leaves(spark):
    rows = [(1, "go on " * 5 + "stop"), (2, "no no no no no"), (3, "ha ha\tha\nha  ha ha ho"), (4, None), (5, "\x00 \x01 \x00 \x01 \x00 \x01 \x00 \x01"), (6, "é " * 6)]
    out = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in periods.collapse_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == ("go on stop", [(0, 10, 2)])
    assert out[2] == ("no no no no no", [])  # five words are too few
    assert out[3] == ("ha ho", [(0, 6, 1)])
    assert out[4] == ("", [])
    assert out[5] == ("\x00 \x01", [(0, 8, 2)])
    assert out[6] == ("é", [(0, 6, 1)])


def test_awkward_rows(spark):
    rows = periods.collapse_runs(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    many = next(r for r in rows if r.n_words == 30_000)
    assert many.collapsed == "x" and [tuple(x) for x in many.runs] == [(0, 30_000, 1)]
    assert periods.collapse_runs(nothing(spark)).collect() == []
    assert periods.collapse_runs(periods.with_repeated_tails(awkward(spark))).count() == len(rows)
