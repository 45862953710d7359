from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placestream.llm import jaccard

from .cases import awkward, nothing
from .test_words import plain


def grams(t):
    w = plain(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = {i: grams(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize(("block", "most"), [(512, 1 << 20), (7, 1 << 20), (512, 300)])
def test_join_equals_brute_force(spark, block, most, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "GRAMS_A_BLOCK", most)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(t)))
    docs += [(1000, ""), (1001, ""), (1002, "short one"), (1003, "Short, one!")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), recall=0.999999 if block == 512 and most > 300 else 0.999).collect()}
    want = brute(docs)
    assert sum(got[i] != want[i] for i in want) <= 2  # the banding misses one pair in a thousand
    assert got[1000] == (1000, 0)
    assert got[1003] == (1002, 1)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = jaccard.jaccard_join(docs).collect()
    assert len(got) == docs.count()
    fours = [r for r in got if r.doc_id == 4]
    assert sorted(r.n_links for r in fours) == [0, 1, 1]
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id = 4").count() == 2
    assert jaccard.jaccard_join(nothing(spark)).count() == 0
    assert jaccard.one_of_each(nothing(spark)).count() == 0


def near(rng, n):
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    return [" ".join([*base, f"end{i}"]) for i in range(n)]


def test_repeated_rows_with_a_near_copy(spark):
    a, b = near(random.Random(1), 2)
    docs = [(1, a), (1, a), (2, b)]
    got = sorted(map(tuple, jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]


def test_rows_without_an_id_meet_once_a_text(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(None, t) for _ in range(20) for t in near(rng, 2)] + [(7, t) for t in near(rng, 2)]
    met = []
    make = jaccard.gram_sets
    monkeypatch.setattr(jaccard, "gram_sets", lambda rows: (met.append(rows.count()), make(rows))[1])
    got = [tuple(r) for r in jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == [(7, 7, 1)] * 2 + [(None, None, 1)] * 40
    assert met == [42]


def test_one_row_of_each_class_stays_whatever_its_ids(spark):
    rng = random.Random(3)
    docs = [(None, t) for _ in range(10) for t in near(rng, 3)] + [(5, t) for _ in range(10) for t in near(rng, 3)] + [(i % 2 or None, t) for i, t in enumerate(near(rng, 4))] + [(None, ""), (None, "")]
    kept = jaccard.one_of_each(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, doc string"))
    assert kept.columns == ["doc_id", "text", "doc"]
    assert sorted((r.doc_id or 0 for r in kept.collect())) == [0] * 12 + [1] + [5] * 10


def test_many_rows_without_an_id_or_of_one_id(spark):
    words = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64((F.col("id") / 2).cast("long"), F.lit(k)), F.lit(10**6)).cast("string")) for k in range(30)])
    for doc_id in (F.lit(None).cast("long"), F.lit(3).cast("long")):
        docs = spark.range(30_000).select(doc_id.alias("doc_id"), words.alias("text"))
        got = jaccard.jaccard_join(docs).groupBy("n_links").count().collect()
        assert [(r.n_links, r["count"]) for r in got] == [(1, 30_000)]


def test_components_of_long_chains(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(1000, 1005).select("id", F.lit(1000).cast("long")))
    got = {r.key: r.root for r in jaccard.components(edges).collect()}
    assert all(got[i] == 0 for i in range(301))
    assert got[1004] == 1000


def test_components_of_random_graphs_with_a_hot_node(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] * 2 + [(700, i) for i in range(1000, 4000)] + [(i, i) for i in (500, 501)]
    root = {i: i for p in pairs for i in p if p[0] != p[1]}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = jaccard.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, find(i)) for i in sorted(root)]


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    cuts = []
    cut = jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df: (cuts.append(df), cut(df))[1])
    edges = spark.range(1, 500).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).union(spark.range(1001, 1005).select("id", F.lit(1000).cast("long")))
    got = {r.key: r.root for r in jaccard.components(edges).collect()}
    assert got == dict.fromkeys(range(500), 0) | dict.fromkeys(range(1000, 1005), 1000)
    assert len(cuts) == 1


def test_jobs_that_the_driver_keeps_for_a_table_of_copies(spark):
    """Each job and its tasks stay in the driver's memory for a while (89 jobs before stars took no round and rows of a class were not joined by document)."""
    rng = random.Random(6)
    docs = spark.createDataFrame(list(enumerate(t for _ in range(10) for t in near(rng, 6))), "doc_id long, text string")
    spark.sparkContext.setJobGroup("one_of_each", "")
    try:
        kept = jaccard.one_of_each(docs).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.doc_id for r in kept) == list(range(0, 60, 6))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one_of_each")) < 65


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands(0.8, 0.999, 144)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    with pytest.raises(ValueError, match="recall"):
        jaccard.choose_bands(0.1, 0.999999, 3)


def test_overlaps_in_parts_equal_set_sizes():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, n, dtype=np.uint64)) for n in (1, 30, 40, 5)]
    want = [[len(set(a) & set(b)) for b in map(set, sets)] for a in map(set, sets)]
    got = jaccard.overlaps(sets, columns=8)
    assert all(got[i][j] == want[i][j] for i in range(4) for j in range(4) if i != j)
