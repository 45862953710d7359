from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from placestream.llm import decontamination as d
from placestream.llm.words import PLAIN, buffers, words

from .cases import awkward, nothing
from .test_words import plain


def edits(item, text):
    """Least edit distance of the item to any run of words of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_matches_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(150)]
    run = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(run(rng.randint(12, 50)))) for i in range(15)]
    docs = []
    for i in range(60):
        words = run(rng.randint(0, 120))
        if i % 3 == 0:
            passage = items[i % 15][1].split()
            for _ in range(rng.randint(0, len(passage) // 5)):
                passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs.append((i, " ".join(words).upper() if i % 6 == 0 else ", ".join(words)))
    want = {(i, k): e for i, t in docs for k, x in items if (e := edits(x.split(), plain(t))) <= 0.2 * len(x.split())}
    got = {(r.doc_id, r.item_id): r.edits for r in d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: want[k] for k in got}  # no false match, distances exact
    assert len(got) >= 0.95 * len(want)
    assert {k for k, e in want.items() if e == 0} <= set(got)


KINDS = {"substitutions": [(1, 1)], "insertions": [(0, 1)], "deletions": [(1, 0)], "mixed": [(1, 1), (0, 1), (1, 0)], "even": [(1, 1)]}


def recall(n, kind, trials=120):
    """Share of items of n words that are found in a text with as many edits as a match may have."""
    rng = random.Random(f"{n} {kind}")
    new = lambda: f"e{rng.randrange(10**9)}"
    items, texts = [], []
    for _ in range(trials):
        items.append([f"w{rng.randrange(5000)}" for _ in range(n)])
        edited = list(items[-1])
        k = n // 5
        for j in range(k):
            at = (2 * j + 1) * n // (2 * k) if kind == "even" else rng.randrange(len(edited))
            gone, come = rng.choice(KINDS[kind])
            edited[at : at + gone] = [new()] * come
        texts.append(" ".join([*[new() for _ in range(9)], *edited, *[new() for _ in range(9)]]))
    index = d.Index(list(range(trials)), [" ".join(x) for x in items])
    found = {(row, item) for row, item, *_ in d._matches(index, words(*buffers(pa.array(texts)), PLAIN))}
    return sum((i, i) in found for i in range(trials)) / trials


@pytest.mark.parametrize("kind", KINDS)
def test_no_short_item_is_missed(kind):
    assert [n for n in range(1, 30) if recall(n, kind) < 1] == []


@pytest.mark.parametrize("kind", KINDS)
def test_recall_of_long_items(kind):
    found = {n: recall(n, kind) for n in (30, 34, 39, 45, 60, 100, 200)}
    assert min(found.values()) >= 0.98, found


def test_distances_equal_the_full_table():
    rng = random.Random(8)
    for _ in range(300):
        item, text = ([rng.randrange(6) for _ in range(rng.randint(1, n))] for n in (12, 40))
        rows = [[0] * (len(text) + 1)]
        for i, a in enumerate(item, 1):
            rows.append([i])
            for j, b in enumerate(text, 1):
                rows[i].append(min(rows[i - 1][j - 1] + (a != b), rows[i - 1][j] + 1, rows[i][-1] + 1))
        least = min(rows[-1])
        assert d.distance(d.masks(np.array(item)), len(item), text) == (least, rows[-1].index(least))


def test_a_long_item_ends_soon():
    rng = random.Random(5)
    item = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    text = [w if rng.random() < 0.9 else "x" for w in item]
    began = time.monotonic()
    (found,) = d._matches(d.Index([1], [" ".join(item)]), words(*buffers(pa.array([" ".join(text)])), PLAIN))
    assert found[4] == sum(a != b for a, b in zip(item, text, strict=True))
    assert time.monotonic() - began < 30


def test_blocks_of_items_find_the_same(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m"), (2, "nothing of the kind"), (3, "m l k j i h g f e d c b a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "m l k j i h g f e d"), (3, None), (4, "")], "item_id long, text string")
    found = lambda n: sorted((r.doc_id, r.item_id) for r in d.contamination(docs, items, n).collect())
    assert found(100) == found(1) == [(1, 1), (3, 2)]
    assert [r.doc_id for r in d.without_benchmark(docs, items, 1).collect()] == [2]


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "one two three"), (None, "x x x x x x x x x x x x")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0) for r in d.contamination(awkward(spark), items).collect())
    assert got == [(4, 1), (4, 1), (8, 0)]
    kept = d.without_benchmark(awkward(spark), items)
    assert kept.columns == awkward(spark).columns
    assert kept.count() == awkward(spark).count() - 3
    assert d.contamination(nothing(spark), items).count() == 0
    assert d.contamination(awkward(spark), items.limit(0)).count() == 0


def test_repeated_words_meet_in_bounded_time_and_memory():
    rng = np.random.default_rng(1)
    words_of = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5_000, n))
    items = ["zero " * 200, *(f"{words_of(40)} {'zero ' * 20} {words_of(40)}" for _ in range(99))]
    index = d.Index(list(range(100)), items)
    texts = ["zero " * 200_000, f"{words_of(500)} {items[7]} {words_of(500)}", f"{words_of(30)} {'zero ' * 190} {words_of(30)}", "zero " * 100 + words_of(200)]
    tracemalloc.start()
    began = time.perf_counter()
    found = {(r, k): (a, b, e) for r, k, a, b, e in d._matches(index, _words(texts))}
    seconds, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.keys() == {(0, 0), (1, 7), (2, 0)}
    assert found[0, 0] == (0, 200, 0) and found[1, 7] == (500, 600, 0) and found[2, 0][2] == 10
    assert seconds < 30 and peak < 300e6


def test_shortened_texts_give_the_same_matches():
    rng = random.Random(2)
    for _ in range(150):
        item = np.array([rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randrange(1, 12))], np.uint64)
        text = np.array([x for _ in range(rng.randrange(1, 6)) for x in [rng.choice([1, 2, 3])] * rng.choice([1, 2, 60])], np.uint64)
        places, reach = d.masks(item), len(item) + d.most_edits(len(item)) + 1
        best, end = d.distance(places, len(item), text.tolist())
        short, at = d.shortened(text, reach)
        again, stop = d.distance(places, len(item), short.tolist())
        if best <= d.most_edits(len(item)):
            assert (best, end) == (again, stop if at is None or not stop else at[stop - 1] + 1)


def _words(texts):
    raw = [t.encode() for t in texts]
    return words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), PLAIN)
