"""Operator 9: language of texts by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fold, table
from .words import buffers, slices

#: Labelled rows the network is trained on, and the bytes of a training piece taken from each.
TRAIN_ROWS, PIECE = 6_000, 64
HIDDEN, EMBED = 12, 8
EPOCHS, BATCH, RATE = 6, 256, 0.01
#: Texts are read in segments of this many bytes, side by side; each direction begins so many bytes before
#: its segment, where the text has them, so that no position is labelled from a few bytes.
SEGMENT, WARM_UP = 128, 16
FOLDS, HELD_OUT = 4, 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Gru:
    """One direction: input terms per byte value (embedding folded in) and recurrent weights."""

    x: np.ndarray  # 256 x 3H: what a byte adds to the gates' inputs
    h: np.ndarray  # H x 3H

    def states(self, bytes_: np.ndarray, inside: np.ndarray, skip: int) -> np.ndarray:
        """Hidden state after each byte of every column: (steps, batch) to (steps - ``skip``, H, batch).

        Where ``inside`` is false, before a text begins, the state stays zero. The batch is the last
        axis, so that gates are whole rows; weights carry the factors of sigmoid(x) = 1 / (1 + exp(-x))
        and tanh(x) = 2 / (1 + exp(-2x)) - 1.
        """
        n = self.h.shape[0]
        factor = np.repeat(np.float32([-1.0, -2.0]), [2 * n, n])
        x, w = self.x * factor, np.ascontiguousarray((self.h * factor).T)
        h = np.zeros((n, bytes_.shape[1]), np.float32)
        out = np.empty((len(bytes_) - skip, *h.shape), np.float32)
        every = inside.all(1)
        with np.errstate(over="ignore"):  # exp may be infinite, which gives 0
            for t, b in enumerate(bytes_):
                row = x[b]
                gates = w[: 2 * n] @ h
                gates += row[:, : 2 * n].T
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                c = w[2 * n :] @ (gates[n:] * h)
                c += row[:, 2 * n :].T
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                c -= h
                c *= gates[:n]
                h += c
                if not every[t]:
                    h *= inside[t]
                if t >= skip:
                    out[t - skip] = h
        return out


def train_step(p: dict[str, np.ndarray], bytes_: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean per-position cross-entropy, by backpropagation through time."""
    steps, batch = bytes_.shape
    n = p["hf"].shape[0]
    tape, outs = {}, {}
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        table_ = p["e"] @ p["x" + d] + p["c" + d]
        h, kept, out = np.zeros((batch, n), np.float32), [], np.empty((steps, batch, n), np.float32)
        for t in order:
            x = table_[bytes_[t]]
            zr = _sigmoid(x[:, : 2 * n] + h @ p["h" + d][:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(x[:, 2 * n :] + (r * h) @ p["h" + d][:, 2 * n :])
            kept.append((t, h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        tape[d], outs[d] = kept, out
    both = np.concatenate([outs["f"], outs["b"]], 2)
    logits = both @ p["w"] + p["v"]
    logits -= logits.max(2, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(2, keepdims=True)
    prob[:, np.arange(batch), label] -= 1
    d_logits = prob / (steps * batch)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["w"], g["v"] = np.tensordot(both, d_logits, ((0, 1), (0, 1))), d_logits.sum((0, 1))
    d_both = d_logits @ p["w"].T
    for d, part in (("f", d_both[:, :, :n]), ("b", d_both[:, :, n:])):
        d_table, wh, dh = np.zeros((256, 3 * n), np.float32), p["h" + d], np.zeros((batch, n), np.float32)
        for t, h, z, r, c in reversed(tape[d]):
            dh = dh + part[t]
            da_c = dh * z * (1 - c * c)
            d_rh = da_c @ wh[:, 2 * n :].T
            da_z = dh * (c - h) * z * (1 - z)
            da_r = d_rh * h * r * (1 - r)
            da = np.concatenate([da_z, da_r, da_c], 1)
            g["h" + d][:, : 2 * n] += h.T @ da[:, : 2 * n]
            g["h" + d][:, 2 * n :] += (r * h).T @ da_c
            np.add.at(d_table, bytes_[t], da)
            dh = dh * (1 - z) + d_rh * r + da[:, : 2 * n] @ wh[:, : 2 * n].T
        g["x" + d], g["c" + d] = p["e"].T @ d_table, d_table.sum(0)
        g["e"] += d_table @ p["x" + d].T
    return g


@dataclass
class Model:
    languages: list[str]
    forward: Gru
    backward: Gru
    w: np.ndarray
    v: np.ndarray

    def pooled(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean class probabilities over every byte position of each row of a slice.

        Rows are cut into segments that run side by side; each is read in both directions, from
        WARM_UP bytes before it, and every position of every segment is labelled.
        """
        rows, k = len(offs) - 1, len(self.languages)
        length = np.diff(offs)
        pieces = -(-length // SEGMENT)
        row = np.repeat(np.arange(rows), pieces)
        first = np.cumsum(pieces) - pieces
        start = offs[:-1][row] + (np.arange(len(row)) - first[row]) * SEGMENT
        size = np.minimum(SEGMENT, offs[1:][row] - start)
        total = np.zeros((rows, k))
        low, high = offs[:-1][row], offs[1:][row]
        edge = np.full(SEGMENT + WARM_UP, 32, np.uint8)
        padded = np.concatenate([edge, raw, edge])
        step = 2048
        for i in range(0, len(row), step):
            s, n = start[i : i + step], size[i : i + step]
            before, after = s + np.arange(-WARM_UP, SEGMENT)[:, None], s + np.arange(SEGMENT + WARM_UP)[::-1, None]
            inside = np.arange(SEGMENT)[:, None] < n[None, :]
            logits = self.w[:HIDDEN].T @ self.forward.states(padded[before + len(edge)], before >= low[i : i + step], WARM_UP)
            logits += self.w[HIDDEN:].T @ self.backward.states(padded[after + len(edge)], after < high[i : i + step], WARM_UP)[::-1]
            logits += self.v[:, None]
            np.exp(logits, out=logits)
            logits *= (inside / logits.sum(1))[:, None, :]
            here = logits.sum(0, dtype=np.float64).T
            for c in range(k):
                total[:, c] += np.bincount(row[i : i + step], here[:, c], minlength=rows)
        return total / np.maximum(length, 1)[:, None]


def train(pieces: np.ndarray, label: np.ndarray, languages: list[str], epochs: int = EPOCHS) -> Model:
    """Adam over the pieces (rows x PIECE bytes) in a fixed random order."""
    rng = np.random.default_rng(7)
    k, n = len(languages), HIDDEN
    shape = {"e": (256, EMBED), "xf": (EMBED, 3 * n), "xb": (EMBED, 3 * n), "cf": (3 * n,), "cb": (3 * n,), "hf": (n, 3 * n), "hb": (n, 3 * n), "w": (2 * n, k), "v": (k,)}
    p = {key: (rng.normal(0, 1 / np.sqrt(s[0]) if len(s) > 1 and key != "e" else 0.5, s) * (len(s) > 1)).astype(np.float32) for key, s in shape.items()}
    m, q, t = {key: np.zeros_like(x) for key, x in p.items()}, {key: np.zeros_like(x) for key, x in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            g = train_step(p, pieces[at].T, label[at])
            t += 1
            rate = RATE * (1 - epoch / epochs)
            for key in p:
                m[key] = 0.9 * m[key] + 0.1 * g[key]
                q[key] = 0.999 * q[key] + 0.001 * g[key] ** 2
                p[key] -= (rate * (m[key] / (1 - 0.9**t)) / (np.sqrt(q[key] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Model(languages, Gru(p["e"] @ p["xf"] + p["cf"], p["hf"]), Gru(p["e"] @ p["xb"] + p["cb"], p["hb"]), p["w"], p["v"])


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> Model | None:
    """Train on at most ``rows`` rows with a language, outside the held-out fold.

    Texts are taken by their hash, equal ones of a language once, the same number per language where
    there are enough, and one of every language at least; ids play no part, so rows that share one, or
    have none, are drawn each for itself. A text gives one piece of PIECE bytes at an offset drawn from
    its hash; a shorter one is filled up with spaces. Only those pieces reach the driver. Without a
    labelled row there is no model.
    """
    learn = docs.filter((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("doc_id", "lang", "text")
    counts = learn.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return None
    languages = sorted(r["lang"] for r in counts)
    each = max(1, rows // len(languages))
    room = F.greatest(F.octet_length("text") - PIECE, F.lit(0)) + 1
    piece = F.substring(F.col("text").cast("binary"), (F.pmod(F.xxhash64("text", F.lit(1)), room) + 1).cast("int"), F.lit(PIECE))
    h = F.xxhash64("text")
    unit = F.pmod(h, F.lit(1 << 20)) / float(1 << 20)
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4.0 * each / r["count"]))])
    cut = learn.filter(unit < shares[F.col("lang")]).select("lang", h.alias("h"), piece.alias("piece")).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece")) <= each
    found = cut.withColumn("first", first).filter("first").select("lang", "piece", "h")
    sample = found.toPandas().sort_values(["lang", "h"], ignore_index=True)
    pieces = np.full((len(sample), PIECE), 32, np.uint8)
    for i, b in enumerate(sample.piece):
        pieces[i, : len(b)] = np.frombuffer(b, np.uint8)
    return train(pieces, np.searchsorted(languages, sample.lang), languages, epochs)


def language(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text).

    The score is the pooled probability of the predicted language; ties go to the first language in
    code-point order. A null text, or one without a letter, is ``und`` with score 0; so is every
    text if nothing could be learned. Whole texts are read; repeated rows are predicted alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for _, raw, offs in slices(*buffers(batch.column(1))):
                pooled = model.pooled(raw, offs) if model else np.zeros((len(offs) - 1, 1))
                best = pooled.argmax(1)
                names += [model.languages[b] if model else "und" for b in best]
                scores.append(pooled[np.arange(len(best)), best])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "lettered", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    rows = docs.select(F.col("doc_id").cast("long"), "text", lettered).mapInArrow(predict, "doc_id long, lettered boolean, lang_pred string, score double")
    return rows.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        F.when(F.col("lettered"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("lettered"), F.least(F.col("score"), F.lit(1.0))).otherwise(0.0).alias("score"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language(docs, fit(docs))
