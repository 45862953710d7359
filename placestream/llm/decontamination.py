"""Operator 4: benchmark passages in documents, by CGK embedding, bit-sampling LSH and exact edits.

Edit distance counts words: insertions, deletions and substitutions between an item and a run of
consecutive words of a document. A CGK walk reads a text word by word and moves on, or stays, by a
random bit of the word and the step, so that few edits change few symbols of the walk. Each
repetition draws its own walk and a few of its steps; where the symbols of a document's walk agree
there with a walk begun in an item, the item-sized window around it is a candidate, and an exact
alignment decides. Walks are short and begin at every word of an item: walks over the whole of an
item drift apart at this share of edits (README). Short items leave walks too few words between
edits; they are also cut into one part more than they may have edits, of which a match holds at
least one word for word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .words import PLAIN, Words, buffers, hash_text, mix, shingles, slices, words

#: Largest edit distance of a match, as a share of the item's words.
MOST_EDITS = 0.2
#: Repetitions and sampled steps of each. Walks begin at every word of a document and at every
#: ANCHOR_HOP-th word of an item. Simulated recall of the walks at MOST_EDITS: 0.99 from SHORT_WORDS on.
REPETITIONS, SAMPLES, ANCHOR_HOP = 6, 6, 1
#: Steps of a walk; shorter items have shorter walks.
STEPS = 12
#: Items below so many words are sought by their parts too, so that none is missed.
SHORT_WORDS = 30
#: Items that one pass over the documents looks for; larger benchmarks take several passes, by a hash of the item.
ITEMS_A_PASS = 20_000
#: Bytes of their texts, whose index takes some ten times as many on the driver and in every task.
BYTES_A_PASS = 8 << 20
#: Places of candidates that are made distinct at a time.
CANDIDATES = 1 << 16
_NO_WORD = np.uint64(0x5DEECE66D1234567)


@dataclass
class Walk:
    """One repetition for items of one length class: its sampled steps and its items' symbols."""

    seed: np.uint64
    steps: np.ndarray
    seen: list[np.ndarray]  # by the top 16 bits of the key of the first 1, 2, ... samples: does an item have it?
    full: np.ndarray  # sorted keys of all samples, repeated where walks of items share one
    item: np.ndarray  # item of each full key
    offset: np.ndarray  # words of the item before the walk's start
    hop: np.ndarray  # words of a text of which one stands for all with this key


@dataclass
class Parts:
    """Parts of one length of the short items."""

    size: int
    seen: np.ndarray  # by the top 16 bits of a key: does a part have it?
    full: np.ndarray  # sorted keys of the parts
    item: np.ndarray
    offset: np.ndarray  # words of the item before the part
    hop: np.ndarray


_TOP = np.uint64(48)


def most_edits(n_words: int) -> int:
    """Edits that a match of an item of so many words may have."""
    return int(MOST_EDITS * n_words + 1e-9)


def _seen(key: np.ndarray) -> np.ndarray:
    table_ = np.zeros(1 << 16, bool)
    table_[(key >> _TOP).astype(np.uint16)] = True
    return table_


def embed(coin: np.ndarray, start: np.ndarray, steps: np.ndarray, seen: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(start, keys of the first 1, 2, ... sampled symbols) of the CGK walks from every ``start``.

    ``coin`` has the seeded hash of every word: its low bits tell at which steps the walk moves on.
    With ``seen`` tables, walks that surely no item shares end at the next sample.
    """
    bits = coin.astype(np.uint16)
    here = None if seen is None else seen[0][(coin >> _TOP).astype(np.uint16)]
    at, key, keys, s = start.astype(np.int32), None, [], 0
    for step in range(int(steps[-1]) + 1):
        if step == steps[s]:
            if seen is None:
                key = coin[at] if key is None else mix(key * np.uint64(31) + coin[at])
                keys.append(key)
            else:
                if key is not None:
                    key = mix(key * np.uint64(31) + coin[at])
                keep = np.flatnonzero(here[at] if key is None else seen[s][(key >> _TOP).astype(np.uint16)])
                start, at = start[keep], at[keep]
                key = coin[at] if key is None else key[keep]
            s += 1
        move = bits[at]
        move >>= np.uint16(step)
        move &= np.uint16(1)
        at = at + move
    return start, keys or [key]


class Index:
    """The walks of a block of items, by length class, ready to be sent to the tasks."""

    def __init__(self, ids: list, texts: list[str], repetitions: int = REPETITIONS, samples: int = SAMPLES):
        self.ids, self.words = [], []
        for i, t in zip(ids, texts, strict=True):
            h = hash_text(t or "", PLAIN)
            if len(h):
                self.ids.append(i)
                self.words.append(h)
        rng = np.random.default_rng(4)
        self.size = size = np.array([len(w) for w in self.words], np.int64)
        self.slack = np.array([most_edits(n) for n in size.tolist()], np.int64)
        walk_steps = np.minimum(size, STEPS)
        walk_steps = np.where(walk_steps >= STEPS, STEPS, 1 << np.log2(np.maximum(walk_steps, 1)).astype(np.int64))
        self.walks: list[Walk] = []
        for steps in np.unique(walk_steps).tolist():
            mine = np.flatnonzero(walk_steps == steps)
            text = np.concatenate([np.append(self.words[i], np.full(STEPS, _NO_WORD)) for i in mine])
            first = np.cumsum([0, *(size[mine] + STEPS)])[:-1]
            # a walk reads about half as many words as it has steps
            offsets = [np.arange(0, max(1, n - steps // 2), ANCHOR_HOP) for n in size[mine]]
            offset, owner = np.concatenate(offsets), np.repeat(mine, [len(o) for o in offsets])
            begin = np.repeat(first, [len(o) for o in offsets]) + offset
            k = min(samples, steps)
            for _ in range(repetitions):
                seed = rng.integers(1, 2**63, dtype=np.uint64)
                quarter = steps // k  # one sampled step in each equal part of the walk
                chosen = np.arange(k) * quarter + rng.integers(0, quarter, k)
                _, keys = embed(mix(text ^ seed), begin, chosen)
                seen = [_seen(key) for key in keys]
                self.walks.append(Walk(seed, chosen, seen, *self._entries(keys[-1], owner, offset)))
        by_size: dict[int, list[tuple[np.uint64, int, int]]] = {}
        for i, item in enumerate(self.words):
            if len(item) < SHORT_WORDS and most_edits(len(item)):  # walks find items without edits
                edges = np.linspace(0, len(item), most_edits(len(item)) + 2).astype(np.int64)
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    (key,), _ = shingles(item[a:b], np.zeros(b - a, np.int64), int(b - a))
                    by_size.setdefault(int(b - a), []).append((key, i, int(a)))
        self.parts: list[Parts] = []
        for n, found in sorted(by_size.items()):
            key, item, offset = (np.array(c) for c in zip(*sorted(found), strict=True))
            self.parts.append(Parts(n, _seen(key), *self._entries(key, item, offset)))

    def _entries(self, key: np.ndarray, item: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, item, offset, hop) sorted by key; of offsets of an item with the same key, as in repetitions, one in a quarter of its edits."""
        hop = self.slack[item] // 4 + 1
        order = np.lexsort((offset, item, key))
        key, item, cell, offset, hop = key[order], item[order], (offset // hop)[order], offset[order], hop[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1])
        key, item, offset, hop = key[new], item[new], offset[new], hop[new]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        least = np.minimum.reduceat(hop, first) if len(first) else hop
        return key, item.astype(np.int32), offset.astype(np.int32), np.repeat(least, np.diff(np.append(first, len(key)))).astype(np.int32)

    def candidates(self, w: Words, hashes: np.ndarray) -> np.ndarray:
        """Distinct (item, row, place) of a slice: about where an item may begin, in steps of half its edits and one.

        A run of one word, in a text as in an item, has the same key at all its places. Only some of them
        are kept, a quarter of the item's edits apart, and places are made distinct by a bounded number
        at a time, so that repetitive texts and items do not meet at every pair of places.
        """
        # every row is followed by no-words, so that a walk never runs into the next row
        place = np.arange(len(w.row)) + w.row * STEPS
        h = np.full(len(w.row) + len(w.first) * STEPS, _NO_WORD)
        h[place] = hashes
        back = np.zeros(len(h), np.int64)
        back[place] = np.arange(len(w.row))
        place = place.astype(np.int32)
        found = [np.zeros(0, np.int64)]
        before, rows = int(self.size.max(initial=0)) + 1, len(w.first)  # one number holds item, row and place
        places = len(w.row) + 2 * before
        if len(self.size) * rows * places >= 1 << 63:
            raise ValueError("a pass has too many items for so long a text")

        def note(key: np.ndarray, word: np.ndarray, of: Walk | Parts) -> None:
            lo, hi = np.searchsorted(of.full, key), np.searchsorted(of.full, key, "right")
            met = np.flatnonzero(hi > lo)
            if not len(met):
                return
            lo, n, word = lo[met], (hi - lo)[met], word[met]
            some = np.unique(np.stack([lo, w.row[word], word // of.hop[lo]], 1), axis=0, return_index=True)[1] if of.hop[lo].max() > 1 else np.arange(len(word))
            lo, n, word = lo[some], n[some], word[some]
            upto = np.cumsum(n)
            at = 0
            while at < len(n):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, "right")))
                many, here = n[at:end], word[at:end]
                entry = np.repeat(lo[at:end] - np.cumsum(many) + many, many) + np.arange(many.sum())
                here, item = np.repeat(here, many), of.item[entry].astype(np.int64)
                begin = here - of.offset[entry]
                new = np.unique((item * rows + w.row[here]) * places + begin // (self.slack[item] // 2 + 1) + before)
                found.append(new)
                at = end
            found[:] = [np.unique(np.concatenate(found))]

        for walk in self.walks:
            start, (key,) = embed(mix(h ^ walk.seed), place, walk.steps, walk.seen)
            if len(start):
                note(key, back[start], walk)
        for part in self.parts:
            key, word = shingles(hashes, w.row, part.size)
            keep = np.flatnonzero(part.seen[(key >> _TOP).astype(np.uint16)])
            note(key[keep], word[keep], part)
        code = np.unique(np.concatenate(found))
        return np.stack([code // places // rows, code // places % rows, code % places - before], 1) if len(code) else np.zeros((0, 3), np.int64)


def masks(item: np.ndarray) -> dict[int, int]:
    """For each word of an item, the places where it stands, as bits of an integer."""
    out: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        out[word] = out.get(word, 0) | 1 << i
    return out


def distance(places: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance of an item of ``n`` words to any run of words of a text, and the first end with it.

    The column of the alignment is two integers of n bits, the rises and falls from cell to cell
    (Myers 1999), so that memory follows the item, and long items cost a few operations a word.
    """
    full, top = (1 << n) - 1, 1 << n - 1
    rises, falls, score = full, 0, n
    best, end = n, 0
    for at, word in enumerate(text, 1):
        equal = places.get(word, 0)
        across = ((equal & rises) + rises ^ rises | equal) & full
        up, down = falls | full & ~(across | rises), rises & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, at
        up, down = up << 1 & full, down << 1 & full
        vertical = equal | falls
        rises, falls = down | full & ~(vertical | up), up & vertical
    return best, end


def shortened(text: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray | None]:
    """A text whose runs of one word keep their first and last ``reach`` words, and where each kept word stood.

    A match is shorter than ``reach`` words, so one inside a longer run is also at the run's beginning.
    """
    if len(text) <= 2 * reach:
        return text, None
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    size = np.diff(np.append(first, len(text)))
    if size.max() <= 2 * reach:
        return text, None
    place = np.arange(len(text)) - np.repeat(first, size)
    kept = np.flatnonzero((place < reach) | (place >= np.repeat(size, size) - reach))
    return text[kept], kept


def _matches(index: Index, w: Words) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, first word, end word, edits) of the verified candidates, best place of each item in a row."""
    if not len(w.row):
        return
    h = w.hashes()
    item, row, begin = index.candidates(w, h).T
    slack, size = index.slack[item], index.size[item]
    begin = begin * (slack // 2 + 1)
    low = np.maximum(w.first[row], begin - 2 * slack)
    high = np.minimum(w.first[row] + w.count[row], begin + size + 2 * slack)
    # windows of an item that overlap are one stretch; they are sorted, and all as long
    start = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (low[1:] > high[:-1]))[: len(item)])
    item, row, slack, size, low, high = item[start], row[start], slack[start], size[start], low[start], high[np.append(start[1:], len(high))[: len(start)] - 1]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    of, places = -1, {}
    for k, r, n, most, lo, hi, before in zip(*(x.tolist() for x in (item, row, size, slack, low, high, low - w.first[row])), strict=True):
        if k != of:
            of, places = k, masks(index.words[k])
        text, at = shortened(h[lo:hi], n + most + 1)
        edits, end = distance(places, n, text.tolist())
        end = end if at is None or not end else int(at[end - 1]) + 1
        if edits <= most:
            key, value = (r, k), (edits, before + end)
            best[key] = min(best.get(key, value), value)
    for (r, k), (edits, end) in sorted(best.items()):
        yield r, k, max(0, end - int(index.size[k])), end, edits


def _blocks(benchmark: DataFrame, items_a_pass: int) -> Iterator[Index]:
    """Indexes over bounded blocks of the benchmark's items, read one block at a time."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long"), F.lower("text").alias("text"))
    size = items.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-size["items"] // items_a_pass), -(-size["bytes"] // BYTES_A_PASS))
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = sorted(((r["item_id"], r["text"]) for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x))
        if rows:
            yield Index([r[0] for r in rows], [r[1] for r in rows])


def contamination(docs: DataFrame, benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, edits, item_words) of every item found in a document.

    A row per document row and item within MOST_EDITS, at its best place (fewest edits, then the
    first end). Words are lower-cased runs of letters and digits, counted from 0; first_word is
    reckoned from the end and the item's length. Null or empty texts and items match nothing.
    Benchmarks of more than ``items_a_pass`` items are searched in blocks, one pass each. Documents
    are not shuffled; repeated rows and repeated items are each reported; an empty side gives an
    empty result.
    """
    schema = "doc_id long, item_id long, first_word long, end_word long, edits long, item_words long"
    source = docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text"))
    parts = []
    for index in _blocks(benchmark, items_a_pass):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = []
                for i, raw, offs in slices(*buffers(batch.column(1))):
                    for row, item, first, end, edits in _matches(index, words(raw, offs, PLAIN)):
                        rows.append((ids[i + row], index.ids[item], first, end, edits, len(index.words[item])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "first_word", "end_word", "edits", "item_words"])

        parts.append(source.mapInArrow(find, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; no shuffle."""
    schema = docs.schema
    for index in _blocks(benchmark, items_a_pass):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, raw, offs in slices(*buffers(batch.column(batch.num_columns - 1))):
                    clean[[i + m[0] for m in _matches(shared.value, words(raw, offs, PLAIN))]] = False
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(clean))

        docs = docs.select("*", F.lower("text")).mapInArrow(keep, schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
