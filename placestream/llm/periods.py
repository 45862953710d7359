"""Periodic runs of words: maximal pairs of an LCP-interval tree, and texts with repetitions collapsed.

A run is a stretch of words with smallest period q, at least max(LEAST_LENGTH, LEAST_TURNS * q) long,
that no word beside it continues. The words of a text are sorted by suffix; the tree of LCP intervals
is walked from its leaves, and every node keeps the positions below it and, apart from each other,
those with the same word before them. Two positions of different children and different words before
are a maximal pair of the node's depth; where their distance q is at most depth / (LEAST_TURNS - 1),
they are the first two turns of a run of depth + q words, which needs no extension to either side.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .words import SPACED_NUL, buffers, slices, span_array, words

LEAST_LENGTH = 6
LEAST_TURNS = 4
#: Two positions of a run of least length share this many words, so shallower nodes hold no run.
LEAST_DEPTH = LEAST_LENGTH - LEAST_LENGTH // LEAST_TURNS


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their first words with another, in order, and the length each shares with the next.

    Suffixes that share fewer than LEAST_DEPTH words may be left out. ``codes`` are numbers below their own count; every text ends with a number of its own, so what
    two suffixes share ends within their texts. As many words as fit into 63 bits are sorted at first;
    then only positions that still agree are ranked by pairs of ranks, over twice the length each time.
    """
    n = len(codes)
    bits = max(1, int(n).bit_length())
    length = min(63 // bits, LEAST_DEPTH)
    packed = np.zeros(n, np.int64)
    for k in range(length):
        packed <<= bits
        packed[: max(0, n - k)] |= codes[k:]
    order = np.argsort(packed, kind="stable")
    ordered = packed[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(first, size)
    active = order[np.repeat(size, size) > 1]
    shared, ranks = np.sort(active), [(length, rank)]
    while len(active):
        key = rank[active].astype(np.int64) * n + rank[active + length]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(new, len(active)))
        group = key[new] // n  # where the group of the shorter length begins
        outer = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        inner = new - np.repeat(new[outer], np.diff(np.append(outer, len(new))))
        rank = rank.copy()
        rank[active] = np.repeat(group + inner, size)
        length *= 2
        ranks.append((length, rank))
        active = active[np.repeat(size, size) > 1]
    shared = shared[np.argsort(rank[shared], kind="stable")]
    a, b, depth = shared[:-1], shared[1:], np.zeros(max(0, len(shared) - 1), np.int64)
    for length, rank in reversed(ranks):
        depth += length * (rank[a + depth] == rank[b + depth])
    for _ in range(ranks[0][0] - 1):  # fewer words than were packed are left; a difference stays one
        depth += codes[a + depth] == codes[b + depth]
    return shared, depth


class _Node:
    """Positions below a node in order, and those with the same word before them."""

    __slots__ = ("by_left", "spots")

    def __init__(self, spot: int, left: int):
        self.spots, self.by_left = [spot], {left: [spot]}


def _joined(big: _Node, small: _Node, depth: int, left: list[int], found: list[tuple[int, int, int]]) -> _Node:
    """Two children of a node of ``depth`` as one; their maximal pairs near enough go to ``found``.

    The smaller child's positions look into the larger's, so a position moves a logarithmic number of
    times. All positions of a window differ by turns of the same period and only the first of them can
    follow another word, so those of a different class are met first or are the whole window.
    """
    if len(big.spots) < len(small.spots):
        big, small = small, big
    reach, spots, by_left = depth // (LEAST_TURNS - 1), big.spots, big.by_left
    for x in small.spots:
        low, high = bisect_left(spots, x - reach), bisect_right(spots, x + reach)
        if low == high:
            continue
        own = by_left.get(left[x])
        others = high - low - (bisect_right(own, x + reach) - bisect_left(own, x - reach) if own else 0)
        while others:
            y = spots[low]
            if left[y] != left[x]:
                found.append((min(x, y), abs(x - y) + depth, abs(x - y)))
                others -= 1
            low += 1
    for x in small.spots:
        insort(spots, x)
    for word, own in small.by_left.items():
        if word in by_left:
            for x in own:
                insort(by_left[word], x)
        else:
            by_left[word] = own
    return big


def maximal_pairs(order: np.ndarray, depth: np.ndarray, left: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, distance) of the maximal pairs that are runs; a run's multiples of its period are among them."""
    found: list[tuple[int, int, int]] = []
    deep = depth >= LEAST_DEPTH
    keep = np.flatnonzero(np.concatenate([deep, [False]]) | np.concatenate([[False], deep]))
    below = np.append(np.where(deep, depth, 0), 0)[keep].tolist()
    open_: list[tuple[int, _Node]] = []
    for x, d in zip(order[keep].tolist(), below, strict=True):
        node = _Node(x, left[x])
        while open_ and open_[-1][0] > d:
            above, other = open_.pop()
            node = _joined(other, node, above, left, found)
        if open_ and open_[-1][0] == d:
            node = _joined(open_.pop()[1], node, d, left, found)
        if d:
            open_.append((d, node))
    return found


def runs_of(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(start, length, period) of the runs of many texts, by start and period.

    ``codes`` numbers the words of the texts one after the other; ``ends`` has the end of each text.
    Starts count words over all texts.
    """
    if not len(codes):
        return np.zeros((0, 3), np.int64)
    texts = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    slot = np.arange(len(codes)) + texts  # after each text comes a place for its end
    own = np.zeros(len(codes) + len(ends), np.int64)
    text, word = np.zeros_like(own), np.zeros_like(own)
    last = ends + np.arange(len(ends))
    text[slot], word[slot] = texts, codes + 1
    text[last] = np.arange(len(ends))  # word 0 stands for the end, once a text
    _, own = np.unique(text * (int(codes.max()) + 2) + word, return_inverse=True)
    order, depth = suffix_order(own.reshape(-1))
    if not len(depth) or depth.max() < LEAST_DEPTH:
        return np.zeros((0, 3), np.int64)
    before = np.concatenate([[0], own[:-1]])
    before[0] = own[last[0]]
    found = np.array(maximal_pairs(order, depth, before.tolist()), np.int64).reshape(-1, 3)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    same = (found[1:, 0] == found[:-1, 0]) & (found[1:, 1] == found[:-1, 1])
    found = found[np.concatenate([[True], ~same])[: len(found)]]  # of one stretch, the least period
    found[:, 0] -= text[found[:, 0]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def word_codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each byte span, the same for the same bytes."""
    return span_array(raw, start, end).dictionary_encode().indices.to_numpy().astype(np.int64)


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, raw, offs in slices(*buffers(batch.column(1))):
            w = words(raw, offs, SPACED_NUL)
            ends = w.first + w.count
            runs = runs_of(word_codes(raw, w.start, w.end), ends)
            row = w.row[runs[:, 0]]
            change = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 0] + runs[:, 1], -1)
            kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            # kept words and the byte behind each, made a space, but for the last of a text
            last = np.append(w.row[kept][1:] != w.row[kept][:-1], True)[: len(kept)]
            edge = np.zeros(len(raw) + 2, np.int8)
            edge[w.start[kept]] += 1
            np.add.at(edge, w.end[kept] + ~last, -1)
            inside = np.cumsum(edge[: len(raw)], dtype=np.int8) > 0
            out = raw.copy()
            out[w.end[kept][~last]] = 32
            at = np.concatenate([[0], np.cumsum(inside)])[offs]
            n, lists = len(offs) - 1, np.searchsorted(row, np.arange(len(offs)))
            texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out[inside].tobytes())).cast(pa.string())
            parts = [pa.array(c) for c in (runs[:, 0] - w.first[row], runs[:, 1], runs[:, 2])]
            found = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
            yield pa.record_batch([batch.column(0).slice(i, n), pa.array(w.count.astype(np.int64)), found, texts], names=["doc_id", "n_words", "runs", "collapsed"])


def collapse_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text).

    Words are separated by spaces and the controls 9 to 13. ``runs`` has every run as struct<start,
    length, period> in words, by start and period; ``collapsed`` joins by one space the words that no
    run contains after its first period. A null text counts as empty: no words, no runs, an empty
    text. Rows with repeated or null ids are treated alike and kept. Texts stay in their tasks; memory
    follows the longest text, and each is read whole.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_collapsed, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


_WORD = regex.compile("[^\x20\x09-\x0d]+")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``docs`` in which a tenth of the texts repeat a part of themselves to their end.

    With h the crc32 of the id in decimal and g = floor(h / 10), a text of n > 0 words whose h is a
    multiple of 10 keeps its words up to a = g mod n; from there on, its next p = 1 + floor((n - a) /
    (3 + g mod 8)) words come again and again. Other texts, and those without an id, stay as they are.
    """

    @F.pandas_udf("string")
    def repeated(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        def one(text: str | None, seed: int) -> str | None:
            found = _WORD.findall(text) if text else []
            if not found:
                return None
            g, n = int(seed), len(found)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            turn, rest = found[a : a + p], n - a
            return " ".join(found[:a] + (turn * (rest // p + 1))[:rest])

        return pd.Series([one(t, g) for t, g in zip(texts, seeds, strict=True)])

    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    picked = F.when(h % 10 == 0, F.col("text"))
    return docs.withColumn("text", F.coalesce(repeated(picked, F.coalesce(F.floor(h / 10), F.lit(0))), F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of which repeat a part of themselves; the longest run and digests of all."""
    rows = collapse_runs(with_repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as lost, r.start as start, r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = rows.withColumns({"best": longest, "lines": lines})
    length = -F.col("best.lost")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
