"""Ordered windows over groups of any size: a group's rows in ranges of time, each with the tail of what lies before it.

A window by host puts all rows of a host into one task. Here the rows of a large group are cut into ranges of
time of about equal size, and each range is given copies of the few rows before it that its windows look back
at. Windows then run by group and range, and the copies are dropped. Small groups are one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, and how many ranges of large groups there are at most: ranges grow with the table beyond.
TARGET_ROWS = 2_000_000
MOST_RANGES = 100_000
_WHOLE = -(1 << 62)
_LEVELS = 40


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch; times without a zone are read in the session's."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def ranged(rows: DataFrame, key: str, ts: str = "ts", least_micros: int = 1, target: int = TARGET_ROWS) -> tuple[DataFrame, bool]:
    """``rows`` with ``_range``, the start of their range of time within their group, and whether any group was cut.

    Groups of more than twice ``target`` rows are cut into equal ranges between their first and last time,
    and those that still hold too many again, so bursts are cut finer than rests. No range is cut to less
    than ``least_micros``, and rows of the same time stay together. Only counts by range are taken, the
    large ones of which, at most MOST_RANGES a level, reach the driver. Rows without a time are in their
    group's first range.
    """
    at, spark = micros(ts), rows.sparkSession
    out = rows.withColumn("_range", F.lit(_WHOLE).cast("long"))
    for level in range(_LEVELS):
        sizes = out.groupBy(key, "_range").agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))
        if not level:
            target = max(target, (sizes.agg(F.sum("n")).first()[0] or 0) // MOST_RANGES)
        extent = F.col("high") - F.col("low") + 1
        parts = F.least(F.ceil(F.col("n") / target), F.floor(extent / least_micros))
        large = sizes.filter((F.col("n") > 2 * target) & (parts >= 2)).select(F.col(key).alias("_key"), F.col("_range").alias("_old"), "low", F.ceil(extent / parts).alias("width")).collect()
        if not large:
            return out, level > 0
        kind = rows.select(F.col(key).alias("_key")).schema["_key"].dataType.simpleString()
        cuts = F.broadcast(spark.createDataFrame(large, f"_key {kind}, _old long, low long, width long"))
        start = F.col("low") + F.floor(F.greatest(at - F.col("low"), F.lit(0)) / F.col("width")) * F.col("width")
        joined = out.join(cuts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_old")), "left")
        out = joined.withColumn("_range", F.coalesce(start, F.col("low"), F.col("_range"))).drop("_key", "_old", "low", "width")
    return out, True


def with_tails(rows: DataFrame, key: str, order: tuple[str, ...] = ("ts", "event_id"), back_rows: int = 0, back_micros: int = 0, known: Column | None = None, target: int = TARGET_ROWS) -> DataFrame:
    """``rows`` with ``_range`` and ``_tail``: each range begins with copies of rows before it, marked as its tail.

    The tail is the last ``back_rows`` rows before the range (of those that are ``known``, if given), from as
    many ranges as hold them, or the rows at most ``back_micros`` before its first.
    """
    at = micros(order[0])
    known = F.lit(True) if known is None else known
    parts, some = ranged(rows, key, order[0], max(1, back_micros), target)
    whole = parts.withColumn("_tail", F.lit(False))
    if not some:
        return whole
    cut = parts.filter(F.col("_range") != _WHOLE)
    in_order = Window.partitionBy(key).orderBy("_range")  # one row a range
    sizes = cut.groupBy(key, "_range").agg(F.count_if(known).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumns({"end": F.sum("n").over(upto), "no": F.sum((F.col("n") > 0).cast("long")).over(upto)})
    sources = sizes.filter("n > 0").select(F.col(key).alias("_key"), F.col("no").alias("_no"), F.col("_range").alias("_from"), F.col("end").alias("_end"), F.col("last").alias("_last"))
    before = F.col("no") - (F.col("n") > 0).cast("long")
    reach = back_rows or 2
    wanted = F.when(before > 0, F.sequence(F.greatest(before - reach + 1, F.lit(1)), before))
    targets = sizes.select(F.col(key).alias("_own"), F.col("_range").alias("_to"), (F.col("end") - F.col("n")).alias("_begin"), F.col("first").alias("_first"), F.explode(wanted).alias("_want"))
    pairs = targets.join(sources, F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_want") == F.col("_no"))).drop("_own", "_want", "_no")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_from"))
    if back_rows:
        last = Window.partitionBy(key, "_range").orderBy(*[F.desc(c) for c in order])
        ends = cut.filter(known).withColumn("_place", F.row_number().over(last)).filter(F.col("_place") <= back_rows)
        pairs = pairs.select("_key", "_from", "_to", (back_rows - F.col("_begin") + F.col("_end")).alias("_take")).filter("_take > 0")
        tails = ends.join(pairs, same).filter("_place <= _take")
    else:
        pairs = pairs.filter(F.col("_last") >= F.col("_first") - back_micros)
        tails = cut.join(pairs, same).filter(at >= F.col("_first") - back_micros)
    tails = tails.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_to").alias("_range"), F.lit(True).alias("_tail"))
    return whole.unionByName(tails)


def settled(rows: DataFrame) -> DataFrame:
    """Rows without the copies, once the windows have looked at them."""
    return rows.filter(~F.col("_tail")).drop("_range", "_tail")
