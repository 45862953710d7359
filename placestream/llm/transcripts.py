"""Operator 5: roles of transcript turns by a hidden Markov model, and canonical rendering.

Turns are the steps of the model, roles its states. A turn emits its lines: each line's speaker
marker, length class, question mark, and whether it opens the turn. Counts over labelled turns give
the parameters. A conversation of any length is decoded in bounded blocks: each block gives the
best score from every entry role to every exit role, the blocks of a conversation are chained, and
each block is then traced back between its two fixed roles. The result is the Viterbi path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, fold, table

#: Turns of a block.
BLOCK_TURNS = 2048
FOLDS, HELD_OUT = 4, 2
# Speaker markers at the start of a line, by what they stand for.
MARKERS = (
    r"(?i)^\s*(?:system|instructions?)\s*[:>]\s*",
    r"(?i)^\s*(?:user|human|customer|question|q)\s*[:>]\s*",
    r"(?i)^\s*(?:assistant|bot|ai|agent|answer|a)\s*[:>]\s*",
)
_LENGTHS = 14
_CODES = (len(MARKERS) + 1) * _LENGTHS * 2 * 2


def line_code(line: Column, first: Column) -> Column:
    """A line's features as one number below _CODES."""
    marker = F.lit(0)
    for k in reversed(range(len(MARKERS))):
        marker = F.when(line.rlike(MARKERS[k]), F.lit(k + 1)).otherwise(marker)
    length = F.least(F.floor(F.log2(F.length(line) + 1)).cast("int"), F.lit(_LENGTHS - 1))
    asks = line.rlike(r"\?\s*$").cast("int")
    return ((marker * _LENGTHS + length) * 2 + asks) * 2 + first.cast("int")


def turn_codes(text: Column) -> Column:
    """The codes of a turn's lines, the opening line first; a null text is one empty line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(lines, lambda line, i: line_code(line, i == 0))


@dataclass
class Model:
    roles: list[str]
    start: np.ndarray
    move: np.ndarray  # log P(next role | role)
    emit: np.ndarray  # log P(code | role)


def fit(turns: DataFrame) -> Model | None:
    """Count starts, moves and emissions over all labelled turns outside the held-out conversations.

    Every role that occurs is learned. Moves are counted between neighbouring turns of the same stretch
    of BLOCK_TURNS turn numbers, so that a conversation of any length is counted in parts; turns without
    a number, or of no known conversation, have no neighbours and count for their lines only. Counts by
    role, by pair of roles and by role and code reach the driver. Add-one smoothing throughout.
    """
    learn = turns.filter((fold(F.col("conv_id"), FOLDS) != HELD_OUT) & F.col("role").isNotNull())
    roles = sorted(r["role"] for r in learn.select("role").distinct().collect())
    if not roles:
        return None
    number = {r: i for i, r in enumerate(roles)}
    stretch = Window.partitionBy("conv_id", F.floor(F.col("turn") / BLOCK_TURNS)).orderBy("turn", "role")
    opens = F.when(F.col("turn") >= BLOCK_TURNS, F.lit("\0"))  # no start in later stretches
    before = learn.filter("conv_id is not null and turn is not null").select("role", F.coalesce(F.lag("role").over(stretch), opens).alias("before")).groupBy("before", "role").count().collect()
    codes = learn.select("role", F.explode(turn_codes(F.col("text"))).alias("code")).groupBy("role", "code").count().collect()
    start, move, emit = np.ones(len(roles)), np.ones((len(roles), len(roles))), np.ones((len(roles), _CODES))
    for b, r, n in before:
        if b is None:
            start[number[r]] += n
        elif b in number:
            move[number[b], number[r]] += n
    for r, c, n in codes:
        emit[number[r], c] += n
    log = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return Model(roles, log(start), log(move), log(emit))


def _emissions(model: Model, codes: pd.Series) -> np.ndarray:
    size = np.array([len(c) for c in codes])
    flat = np.concatenate([np.asarray(c, np.int64) for c in codes])
    return np.add.reduceat(model.emit[:, flat], np.cumsum(size) - size, 1).T


def _segments(block: pd.DataFrame) -> Iterator[tuple[int, int]]:
    ids = block.conv_id.astype("object").where(block.conv_id.notna(), None).to_numpy()
    edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
    yield from zip(edges[:-1], edges[1:], strict=True)


def _forward(model: Model, e: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best scores after the steps ``e`` from rows of ``score`` (already at the first step), and the steps' best predecessors."""
    back = np.zeros((len(e), *score.shape), np.int64)
    for t in range(1, len(e)):
        each = score[:, :, None] + model.move[None]
        back[t] = each.argmax(1)
        score = each.max(1) + e[t]
    return score, back


def _begin(model: Model, e0: np.ndarray, fresh: bool) -> np.ndarray:
    """Scores at a segment's first step: one row for a fresh start, else one row an entry role."""
    return (model.start + e0)[None, :] if fresh else model.move + e0


def parse_turns(turns: DataFrame, model: Model | None) -> DataFrame:
    """(conv_id, turn, held_out, role, rendered) of every row of ``turns`` (conv_id, turn, text).

    Order within a conversation: turn (null first), then text; rows that repeat both are turns of
    their own. Of equally good paths the one with the earlier roles (in name order) at the end
    counts. ``rendered`` is the canonical form of the turn: its role header, then its
    lines without speaker markers and outer white space. Null text is an empty turn; null
    conv_id is one conversation; an empty table gives an empty result. If nothing could be learned
    the role is null. A given role column is never read here.
    """
    spark = turns.sparkSession
    ordered = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text").repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "text").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "text")
    rows = cut(ordered.withColumn("rid", F.monotonically_increasing_id()))
    block = F.floor(F.col("rid") / BLOCK_TURNS)  # parts begin at multiples of 2**33
    coded = rows.select("rid", "conv_id", block.alias("block"), turn_codes(F.col("text")).alias("codes"))
    if model is None:
        named = rows.select("rid", F.lit(None).cast("string").alias("role"))
    else:
        shared = spark.sparkContext.broadcast(model)
        k = len(model.roles)

        def summarise(b: pd.DataFrame) -> pd.DataFrame:
            """First and last segment of a block: best score from each entry role to each exit role."""
            b = b.sort_values("rid", ignore_index=True)
            m, out, parts = shared.value, [], list(_segments(b))
            for lo, hi in {parts[0], parts[-1]}:
                e = _emissions(m, b.codes[lo:hi])
                fresh, _ = _forward(m, e, _begin(m, e[0], True))
                inner, _ = _forward(m, e, _begin(m, e[0], False))
                out.append((b.conv_id[lo], b.rid[lo], fresh[0].tolist(), inner.ravel().tolist()))
            return pd.DataFrame(out, columns=["conv_id", "first", "fresh", "inner"]).astype({"conv_id": "Int64"})

        def chain(segments: pd.DataFrame) -> pd.DataFrame:
            """Entry and exit role of each segment of one conversation on its best path."""
            s = segments.sort_values("first", ignore_index=True)
            inner = [np.array(x).reshape(k, k) for x in s["inner"]]
            score, back = np.array(s.fresh[0]), []
            for x in inner[1:]:
                each = score[:, None] + x
                back.append(each.argmax(0))
                score = each.max(0)
            leave = [int(score.argmax())]
            for b in reversed(back):
                leave.append(int(b[leave[-1]]))
            leave.reverse()
            return pd.DataFrame({"first": s["first"], "enter": [-1, *leave[:-1]], "leave": leave})

        ends = cut(coded.groupBy("block").applyInPandas(summarise, "conv_id long, first long, fresh array<double>, inner array<double>"))
        fixed = ends.groupBy("conv_id").applyInPandas(chain, "first long, enter int, leave int")
        marked = coded.join(fixed, coded["rid"] == fixed["first"], "left").drop("first")

        def decode(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("rid", ignore_index=True)
            m, roles = shared.value, np.zeros(len(b), np.int64)
            for lo, hi in _segments(b):
                e = _emissions(m, b.codes[lo:hi])
                enter = -1 if pd.isna(b.enter[lo]) else int(b.enter[lo])
                score, back = _forward(m, e, _begin(m, e[0], enter < 0))
                row = max(enter, 0)
                state = int(score[row].argmax()) if pd.isna(b.leave[lo]) else int(b.leave[lo])
                for t in range(hi - lo - 1, -1, -1):
                    roles[lo + t] = state
                    state = int(back[t][row, state])
            return pd.DataFrame({"rid": b.rid, "role": [m.roles[r] for r in roles]})

        named = marked.groupBy("block").applyInPandas(decode, "rid long, role string")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(F.regexp_replace(x, "|".join(m.replace("(?i)", "") for m in MARKERS).join(("(?i)(?:", ")")), "")))
    body = F.array_join(lines, "\n")
    whole = rows.join(named, "rid")
    header = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"))
    return whole.select("conv_id", "turn", (fold(F.col("conv_id"), FOLDS) == HELD_OUT).alias("held_out"), "role", F.concat(header, body, F.lit("\n")).alias("rendered"))


def op5_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return parse_turns(turns, fit(turns))
