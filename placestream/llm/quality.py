"""Operator 10: quality rules and a hashed n-gram log-likelihood ratio against the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table
from .words import SPACED_NUL, buffers, mix, shingles, slices, span_hashes, words

#: Hash buckets of the two multinomials, and bytes of an n-gram.
BUCKETS, NGRAM = 1 << 15, 4
#: Base rules.
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 0.30
#: A good document lost weighs as much as so many bad ones kept, when the threshold is set.
KEEP_WEIGHT = 10
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
#: Bytes that begin a code point of a word.
_LEADS = np.array([b & 0xC0 != 0x80 and b != 32 and not 9 <= b <= 13 for b in range(256)], np.int64)


def buckets(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte n-gram that lies within a row, and the n-grams of each row."""
    n = len(raw) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
    key = raw[:n].astype(np.uint32)
    for k in range(1, NGRAM):
        key |= raw[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    key *= np.uint32(2654435761)
    key >>= np.uint32(32 - BUCKETS.bit_length() + 1)
    count = np.maximum(np.diff(offs) - NGRAM + 1, 0)
    if (np.diff(offs)[:-1] > 0).any() and len(offs) > 2:
        whole = np.ones(n, bool)
        for k in range(1, NGRAM):
            at = offs[1:-1] - k
            whole[at[(at >= 0) & (at < n)]] = False
        key = key[whole]
    return key, count


@dataclass
class Model:
    ratio: np.ndarray  # log-likelihood ratio of each bucket
    threshold: float  # least mean ratio of a kept document

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean log-likelihood ratio of the n-grams of each row, to 9 places, so that neighbours in a batch do not show; 0 where there is none."""
        key, count = buckets(raw, offs)
        total = np.concatenate([[0.0], np.cumsum(self.ratio[key], dtype=np.float64)])
        last = np.cumsum(count)
        return np.round((total[last] - total[last - count]) / np.maximum(count, 1), 9) + 0.0


def _trusted(labels: DataFrame, quality: int) -> DataFrame:
    """Ids of the rows with this label."""
    return labels.filter((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def _counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all ``texts`` (text), counted by task before they are summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, raw, offs in slices(*buffers(batch.column(0))):
                seen += np.bincount(buckets(raw, offs)[0], minlength=BUCKETS)
        used = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(used), pa.array(seen[used])], names=["bucket", "n"])

    counts = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    out = np.zeros(BUCKETS)
    out[counts.bucket] = counts.n
    return out


def threshold(scored: DataFrame) -> float:
    """The score that best separates all good rows from all bad ones of ``scored`` (score, kind).

    The share of good rows at or above it, times ``KEEP_WEIGHT``, plus the share of bad rows below it is
    the greatest of all scores (the smallest score on ties, in exact arithmetic). Rows are counted by
    score and dealt by ranges of it; each range gives its counts and its best score, one row a range.
    Without good or without bad rows it is minus infinity.
    """
    counts = scored.groupBy("score").agg(F.count_if(F.col("kind") == 1).alias("good"), F.count_if(F.col("kind") == 0).alias("bad"))
    dealt = cut(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect()
    good, bad = sum(r.good for r in totals), sum(r.bad for r in totals)
    if not good or not bad:
        return -np.inf
    before = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    exact = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("decimal(18,0)")
    gain = F.lit(good).cast("decimal(18,0)") * exact("bad") - F.lit(KEEP_WEIGHT * bad).cast("decimal(18,0)") * exact("good")
    best = dealt.select("part", F.struct(gain.alias("gain"), (-F.col("score")).alias("minus")).alias("b")).groupBy("part").agg(F.max("b").alias("b"))
    best = {r.part: r.b for r in best.collect()}
    found, start = [], 0
    for r in totals:
        found.append((start + int(best[r.part].gain), best[r.part].minus))
        start += good * r.bad - KEEP_WEIGHT * bad * r.good
    return -max(found)[1]


def fit(docs: DataFrame, labels: DataFrame, trusted_rows: int | None = None, rejected_rows: int | None = None) -> Model:
    """Count both multinomials over the corpus and set the threshold.

    The raw multinomial counts every n-gram of every document, the target those of every document
    labelled good; labels meet documents in a shuffle. The threshold is the score that best separates
    all rows labelled good from all labelled bad, good ones weighing more (smallest on ties); without
    bad rows nothing is rejected by it. An id labelled both ways counts as good. Labels need (doc_id,
    quality). Only a caller that gives ``trusted_rows`` or ``rejected_rows`` has the threshold learn from
    at most so many rows of that kind, those with the least hashes of their texts.
    """
    good, bad = _trusted(labels, 1), _trusted(labels, 0)
    raw = _counts(docs.select("text"))
    target = _counts(docs.select("doc_id", "text").join(good.hint("shuffle_hash"), "doc_id").select("text"))
    smooth = lambda c: (c + 1.0) / (c.sum() + BUCKETS)
    ratio = np.log(smooth(target)) - np.log(smooth(raw)) if target.sum() else np.zeros(BUCKETS)
    model = Model(ratio.astype(np.float32), -np.inf)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(raw, offs) for _, raw, offs in slices(*buffers(batch.column(0)))]
            yield pa.record_batch([pa.array(np.concatenate(parts) if parts else np.zeros(0)), batch.column(1), batch.column(2)], names=["score", "doc_id", "h"])

    # ids and scores are shuffled, no texts
    kinds = good.withColumn("kind", F.lit(1)).union(bad.withColumn("kind", F.lit(0))).groupBy("doc_id").agg(F.max("kind").alias("kind"))
    known = docs.filter("doc_id is not null").select("text", F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"))
    every = known.mapInArrow(score, "score double, doc_id long, h long").join(kinds, "doc_id").select("score", "kind", "h")
    limits = {kind: most for kind, most in ((1, trusted_rows), (0, rejected_rows)) if most is not None}
    if limits:
        every = cut(every)
        drawn = reduce(DataFrame.unionByName, (every.filter(F.col("kind") == kind).orderBy("h", "score").limit(most) for kind, most in limits.items()))
        every = every.filter(~F.col("kind").isin(list(limits))).unionByName(docs.sparkSession.createDataFrame(drawn.toPandas(), every.schema))
    model.threshold = threshold(every)
    return model


def rules(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row of a slice."""
    rows = len(offs) - 1
    w = words(raw, offs, SPACED_NUL)
    summed = lambda per_byte: np.diff(np.concatenate([[0], np.cumsum(per_byte)])[offs])
    out = {"n_words": w.count, "word_chars": summed(_LEADS[raw]), "n_symbols": summed(_SYMBOL[raw])}
    # lines: spans between line feeds, each row's first line beginning with the row
    feeds = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offs[:-1], feeds + 1]))
    starts = starts[starts < len(raw)]
    row = np.searchsorted(offs, starts, "right") - 1
    ends = np.append(starts[1:], len(raw))
    ends = ends - ((ends > starts) & (raw[ends - 1] == 10) if len(raw) else 0)
    has_word = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, row = starts[has_word], ends[has_word], row[has_word]
    if len(starts):
        lines = span_hashes(raw, starts, ends) ^ mix(row.astype(np.uint64))
        _, first = np.unique(lines, return_index=True)
        repeated = np.ones(len(lines), bool)
        repeated[first] = False
        out["n_dup_lines"] = np.bincount(row[repeated], minlength=rows)
    else:
        out["n_dup_lines"] = np.zeros(rows, np.int64)
    # words inside 8-word windows that the row holds twice or more
    keys, at = shingles(w.hashes(), w.row, REPEAT_WINDOW)
    out["n_repeat_words"] = np.zeros(rows, np.int64)
    if len(keys):
        keys ^= mix(w.row[at].astype(np.uint64))
        order = np.argsort(keys)
        equal = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][equal]] = twice[order[:-1][equal]] = True
        cover = np.zeros(len(w.row) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + REPEAT_WINDOW, -1)
        out["n_repeat_words"] = np.bincount(w.row[np.cumsum(cover)[:-1] > 0], minlength=rows)
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, base_failed, score and kept.

    Null text counts as empty: no words, base_failed, not kept. A text too short for an n-gram
    scores 0. Ties at the threshold are kept. Repeated rows are judged alike; an empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts = [rules(raw, offs) | {"score": model.scores(raw, offs)} for _, raw, offs in slices(*buffers(batch.column(1)))]
            if parts:
                cols = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
                failed = (cols["n_words"] < LEAST_WORDS) | (100 * cols["n_repeat_words"] > round(100 * MOST_REPEATED) * cols["n_words"])
                kept = ~failed & (cols["score"] >= model.threshold)
                yield pa.record_batch([batch.column(0), *(pa.array(cols[k].astype(np.int64)) for k in _COUNTS), pa.array(failed), pa.array(cols["score"].astype(np.float64)), pa.array(kept)], names=["doc_id", *_COUNTS, "base_failed", "score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in _COUNTS) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, table(spark, sf_dir, "labels")))
