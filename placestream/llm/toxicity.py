"""Operator 6: toxicity by non-negative positive-unlabelled learning on hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, fold, table
from .words import PLAIN, Words, buffers, slices, span_hashes, words

#: Confirmed toxic rows and unlabelled texts that the classifier is fitted on.
POSITIVE_ROWS, UNLABELLED_ROWS = 6_000, 18_000
#: Hash buckets of the features; bytes of the word prefixes that are features beside whole words.
BUCKETS, PREFIXES = 1 << 18, (4, 5, 6)
FOLDS, HELD_OUT = 5, 0
EPOCHS, MOMENTUM, DECAY = 400, 0.9, 2e-4
#: Features that the classifier may use: seen in so many positive rows, so far above the unlabelled share.
LEAST_ROWS, LEAST_Z = 3, 5.0


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct feature of each row: words and prefixes of words."""
    parts = [span_hashes(w.bytes, w.start, w.end)]
    rows = [w.row]
    for k in PREFIXES:
        long = w.end - w.start > k
        start = w.start[long]
        parts.append(span_hashes(w.bytes, start, start + k) + np.uint64(k))
        rows.append(w.row[long])
    key = np.concatenate(parts) % np.uint64(BUCKETS) | np.concatenate(rows).astype(np.uint64) << np.uint64(32)
    key = np.unique(key)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    prior: float

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        row, bucket = features(words(raw, offs, PLAIN))
        z = self.bias + np.bincount(row, self.weight[bucket], minlength=len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Buckets that stand out in the positive rows: in ``LEAST_ROWS`` of them, ``LEAST_Z`` deviations above the unlabelled share."""
    share = (in_u + 1) / (n_u + 2)
    z = (in_p / n_p - share) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    return (in_p >= LEAST_ROWS) & (z >= LEAST_Z)


def nnpu(row: np.ndarray, bucket: np.ndarray, positive: np.ndarray, prior: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative PU risk (logistic loss l).

    ``row`` and ``bucket`` are the features of the rows, ``positive`` flags the rows.

    risk = prior E_p[l(g)] + max(0, E_u[l(-g)] - prior E_p[l(-g)]). Where the estimated negative
    part falls below zero its gradient is followed the other way, as the method prescribes. Full
    batches with momentum; the mean of the second half of the steps is kept, so that the turns of
    the correction even out and the result is the same on every run.

    Each weight has a step of its own, from the rows: the inverse of a row sum that bounds the curvature
    (l'' <= 1/4, and a row of k features adds k + 1 entries to each of its sums). The diagonal of these
    sums is never below the curvature, so steps stay stable however many features occur together.
    """
    used = np.unique(bucket)
    at = np.searchsorted(used, bucket)
    n, n_p, n_u = len(positive), positive.sum(), (~positive).sum()
    sums = np.where(positive, prior / n_p, 1 / n_u) * (np.bincount(row, minlength=n) + 1) / 4
    step = 1 / (np.append(np.bincount(at, sums[row], minlength=len(used)), sums.sum()) + DECAY)
    w, v, mean = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    w[-1] = np.log(prior / (1 - prior))
    for epoch in range(epochs):
        z = w[-1] + np.bincount(row, w[at], minlength=n)
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        negative = np.logaddexp(0, z)  # l(-g)
        part = negative[~positive].sum() / n_u - prior * negative[positive].sum() / n_p
        slope_n = np.where(positive, -prior / n_p, 1 / n_u) * s
        by_row = np.where(positive, prior / n_p * (s - 1), 0.0) + slope_n if part >= 0 else -slope_n
        grad = np.append(np.bincount(at, by_row[row], minlength=len(used)) + DECAY * w[:-1], by_row.sum())
        v = MOMENTUM * v - step * grad
        w = w + v
        if epoch >= epochs // 2:
            mean += w / (epochs - epochs // 2)
    weight = np.zeros(BUCKETS)
    weight[used] = mean[:-1]
    return weight, float(mean[-1])


def fit(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model:
    """Fit on at most ``positive_rows`` toxic rows and ``unlabelled_rows`` texts outside the held-out fold.

    Both samples are taken in the order of a hash of the id. The class prior is the toxic share of
    all labelled rows outside that fold. A first pass counts in how many sampled rows each bucket
    occurs, a second gathers the telling buckets of each sampled row; nothing else reaches the
    driver. Without a toxic row, or an unlabelled one, every text scores the same, low.
    """
    learn = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    marked = labels.filter(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    prior = marked.agg(F.avg("toxic")).first()[0] or 0.0
    by_hash = lambda df, n: df.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    positive = by_hash(marked.filter("toxic = 1"), positive_rows).select("doc_id", F.lit(True).alias("p"))
    unlabelled = by_hash(docs.filter(learn & F.col("doc_id").isNotNull()), unlabelled_rows).select("doc_id", F.lit(False).alias("p"))
    sample = cut(positive.union(unlabelled).distinct())
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "p")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            total += np.bincount(kind, minlength=2)
            for i, raw, offs in slices(*buffers(batch.column(0))):
                row, bucket = features(words(raw, offs, PLAIN))
                for k in (0, 1):
                    seen[k] += np.bincount(bucket[kind[i + row] == k], minlength=BUCKETS)
        used = np.flatnonzero(seen.any(0))
        yield pa.record_batch([pa.array(np.append(used, -1)), pa.array(np.append(seen[0, used], total[0])), pa.array(np.append(seen[1, used], total[1]))], names=["bucket", "n_u", "n_p"])

    counted = rows.mapInArrow(count, "bucket long, n_u long, n_p long").groupBy("bucket").agg(F.sum("n_u").alias("n_u"), F.sum("n_p").alias("n_p"))
    counts = counted.filter(f"bucket < 0 or n_p >= {LEAST_ROWS}").toPandas()  # at most BUCKETS + 1 rows
    all_ = counts[counts.bucket < 0]
    n_p, n_u = (int(all_[c].sum()) for c in ("n_p", "n_u"))
    none = Model(np.zeros(BUCKETS), -3.0, prior)
    if not n_p or not n_u:
        return none
    counts = counts[counts.bucket >= 0]
    chosen = np.zeros(BUCKETS, bool)
    chosen[counts.bucket[telling(counts.n_p.to_numpy(), counts.n_u.to_numpy(), n_p, n_u)]] = True

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for _, raw, offs in slices(*buffers(batch.column(0))):
                row, bucket = features(words(raw, offs, PLAIN))
                row, bucket = row[chosen[bucket]], bucket[chosen[bucket]]
                ends = np.cumsum(np.bincount(row, minlength=len(offs) - 1))[:-1]
                packed += [x.astype(np.int32).tobytes() for x in np.split(bucket, ends)]
            yield pa.record_batch([pa.array(packed, pa.binary()), batch.column(1)], names=["f", "p"])

    found = sorted(rows.mapInArrow(gather, "f binary, p boolean").collect(), key=lambda r: (r.p, r.f))  # the same order on every run
    row = np.repeat(np.arange(len(found)), [len(r.f) // 4 for r in found])
    bucket = np.frombuffer(b"".join(r.f for r in found), np.int32).astype(np.int64)
    prior = min(max(prior, 0.01), 0.9)
    weight, bias = nnpu(row, bucket, np.array([r.p for r in found], bool), prior)
    return Model(weight, bias, prior)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Null and empty texts have no feature and score by the bias alone. A score of exactly 0.5 counts
    as toxic. Repeated rows score alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(raw, offs) for _, raw, offs in slices(*buffers(batch.column(1)))]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(raw, offs) < 0.5 for _, raw, offs in slices(*buffers(batch.column(at)))]
            yield batch.filter(pa.array(np.concatenate(parts))) if parts else batch

    return docs.mapInArrow(keep, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
