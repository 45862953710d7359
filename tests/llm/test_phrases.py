"""Collocations against brute force: lengths, cuts, redundant phrases, ties, saturated tables of bits, awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from placestream.llm import phrases

from .cases import awkward, nothing

SCHEMA = "doc_id long, lang string, text string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow(rows, least, longest, share=50, best=2000):
    f: dict[str, Counter] = {}
    for lang, text in rows:
        mine = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            for m in range(1, longest + 1):
                mine.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, mine in f.items():
        n = sum(c for p, c in mine.items() if len(p) == 1)
        found = {p: c for p, c in mine.items() if len(p) > 1 and c >= least}
        most: Counter = Counter()
        for p, c in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    most[p[i : i + m]] = max(most[p[i : i + m]], c)
        scored = []
        for p, a in found.items():
            if p in most and 100 * most[p] >= share * a:
                continue
            score, _, left, r = min((1_000_000 * a * a // (mine[p[:k]] * mine[p[k:]]), k, mine[p[:k]], mine[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, r))
        out += [(lang, i + 1, p.decode(), -a, left, r, n, -s) for i, (s, a, p, left, r) in enumerate(sorted(scored)[:best])]
    return sorted(out)


def fast(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def corpus(seed, docs=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "in", "a", "ÄRA", "été", "\x00", "\x01", "word"]
    rows = []
    for i in range(docs):
        text = ""
        for _ in range(rng.randrange(60)):
            text += rng.choice(["new york city", *vocabulary, *vocabulary]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", "!?", ",", "\x0b"])
        rows.append((i, rng.choice(["en", "de", None]), text))
    return rows


@pytest.mark.parametrize(("least", "longest", "best"), [(4, 3, 2000), (2, 4, 7), (1, 2, 50)])
def test_phrases_are_those_of_brute_force(spark, least, longest, best):
    rows = corpus(least)
    got = fast(phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=least, longest=longest, best=best))
    assert got == slow([r[1:] for r in rows], least, longest, best=best) != []


def test_a_full_table_of_bits_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 3)
    monkeypatch.setattr(phrases, "LEAST_BITS", 1 << 3)
    rows = corpus(9)
    assert fast(phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=5)) == slow([r[1:] for r in rows], 5, 3)


def test_slices_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_ROWS", 50)
    monkeypatch.setattr(phrases, "ROW_WORDS", 7)
    rows = [(1, "en", "ab cd " * 3_000), (2, "en", "x" * 50_000), (3, "en", "ab cd ef. " * 40), *corpus(3, 20)]
    assert fast(phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(2))) == slow([r[1:] for r in rows], 10, 3)


def test_table_of_bits_has_every_group(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, (500, 3))
    members = phrases._Members(spark.createDataFrame(keys.tolist(), "k1 long, k2 long, k3 long"), ["k1", "k2", "k3"])
    assert members.has(keys).all()
    assert members.has(rng.integers(-(1 << 63), (1 << 63) - 1, (20_000, 3))).mean() < 0.05


def test_products_beyond_64_bits(spark):
    n = 3_000_000_000
    every = spark.createDataFrame([(1, "en", "a", 2 * n + 1), (2, "en", "b", n + 7)], "k1 long, lang string, word string, n long")
    groups = [spark.createDataFrame([(1, 2, n)], "k1 long, k2 long, n long")]
    row = phrases.score_phrases(every, groups).first()
    assert (row.score, row.n) == (1_000_000 * n * n // ((2 * n + 1) * (n + 7)), 3 * n + 8)


def test_words_that_share_a_key_get_new_keys(spark):
    one, other = "a", "b"  # of this sequence and its complement, polynomials modulo a power of two have the same value
    for _ in range(12):
        one, other = one + other, other + one
    pair = np.frombuffer((one + other).encode(), np.uint8)
    same = phrases.span_hashes(pair, np.array([0, len(one)]), np.array([len(one), 2 * len(one)]))
    assert same[0] == same[1]
    rows = [(i, "en", f"{one} x {other} y") for i in range(12)]
    assert fast(phrases.collocations(spark.createDataFrame(rows, SCHEMA))) == slow([r[1:] for r in rows], 10, 3)


def test_awkward_rows(spark):
    rows = [(r.lang, r.text) for r in awkward(spark).collect()]
    assert fast(phrases.collocations(awkward(spark))) == slow(rows, 10, 3)
    assert phrases.collocations(nothing(spark)).collect() == []


def test_rows_hold_whole_pieces_and_stay_small(spark):
    text = "a b c d. e f " * 400
    source = pa.record_batch([pa.array(["en", "en"]), pa.array([1, 1]), pa.array([text, "x y"])], names=["lang", "seed", "text"])

    class All:
        def has(self, keys):
            return np.ones(len(keys), bool)

    (made,) = phrases._first_relation(All(), phrases.span_hashes)(iter([source]))
    sizes = np.diff(made.column(0).offsets.to_numpy())
    assert sizes.sum() == 2402 and sizes.max() < phrases.ROW_WORDS + 6 and len(sizes) == 20
    joined = sum(len(keys) for _, _, _, keys in phrases._joined(iter([made]), 1))
    assert joined == 3 + 399 * 5 + 1 + 1  # pieces of four, six and two words
