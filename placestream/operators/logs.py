"""Ordered logs per user: epochs, newest rows, milestones, collections, settings, properties.

A log row has user_key, ts, event_id, is_clear, is_hit and canton. Rows are ordered by (ts,
event_id). A clear empties the log; a throw that hit or missed is an entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placestream import constants as C

_ORDER = ("ts", "event_id")
#: Cantons of a stamp card.
MOST_CANTONS = 1_000


def log_epochs(log: DataFrame) -> DataFrame:
    """Log rows with their epoch: how often the user had cleared the log up to that row."""
    w = Window.partitionBy("user_key").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("epoch", F.sum(F.coalesce("is_clear", F.lit(False)).cast("int")).over(w))


def numbered(log: DataFrame) -> DataFrame:
    """Entries with their epoch and their number ``rn`` in it, from 1."""
    w = Window.partitionBy("user_key", "epoch").orderBy(*_ORDER)
    return log_epochs(log).filter(~F.coalesce("is_clear", F.lit(False))).withColumn("rn", F.row_number().over(w))


def latest_log(log: DataFrame, n: int = C.LOG_SIZE) -> DataFrame:
    """The newest ``n`` entries of each user since the last clear, with ``place`` 1 for the newest.

    The newest ``n`` rows of a user, clears among them, hold all of these: only so many rows of a task
    go on to be ranked, a long history is not brought together, and no join is needed to find the last
    clear. A row whose ``is_clear`` is null is an entry.
    """
    by_user = Window.partitionBy("user_key")
    newest = by_user.orderBy(F.desc("ts"), F.desc("event_id"))
    rows = log.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n)
    clear = F.coalesce("is_clear", F.lit(False))
    cleared = F.min(F.when(clear, F.col("place"))).over(by_user)
    return rows.withColumn("_cleared", cleared).filter(F.col("_cleared").isNull() | (F.col("place") < F.col("_cleared"))).drop("_cleared")


def canton_milestones(log: DataFrame, n: int = C.LOG_SIZE) -> DataFrame:
    """Hits whose canton is not among the ``n`` entries before, with the cantons collected after it.

    A canton comes in when its last hit lies more than ``n`` entries back, and drops out ``n`` + 1
    entries after a hit that no other follows in time. The number collected is the running sum of
    those few events, so no row looks over a window of ``n``. ``log_size`` counts the throw itself.
    """
    seen = F.when(F.col("is_hit"), F.nullif(F.col("canton").cast("string"), F.lit("")))
    rows = numbered(log).withColumn("seen", seen).filter("seen is not null")
    same = Window.partitionBy("user_key", "epoch", "seen").orderBy("rn")
    rows = rows.withColumns({"since": F.col("rn") - F.lag("rn").over(same), "until": F.lead("rn").over(same) - F.col("rn")})
    far = lambda c: F.col(c).isNull() | (F.col(c) > n)
    comes = F.when(far("since"), F.struct(F.col("rn").alias("at"), F.lit(1).alias("change")))
    goes = F.when(far("until"), F.struct((F.col("rn") + n + 1).alias("at"), F.lit(-1).alias("change")))
    events = rows.select("user_key", "epoch", "event_id", "ts", "seen", "rn", F.explode(F.array_compact(F.array(comes, goes))).alias("e"))
    running = Window.partitionBy("user_key", "epoch").orderBy("e.at", "e.change", "rn").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("collected", F.sum("e.change").over(running)).filter("e.change = 1")
    return events.select("user_key", "event_id", "ts", F.col("seen").alias("canton"), "collected", F.least(F.col("rn"), F.lit(n + 1)).alias("log_size"))


def all_cantons_milestones(log: DataFrame, total: int = len(C.CANTONS), n: int = C.LOG_SIZE) -> DataFrame:
    """Milestones at which the last missing canton came in, with the throw count of that moment."""
    return canton_milestones(log, n).filter(F.col("collected") == total).select("user_key", "event_id", "ts", F.col("log_size").alias("throw_count"))


def skins_table(spark) -> DataFrame:
    return spark.createDataFrame([s for s in C.SKINS], "skin string, threshold int")


def skin_milestones(log: DataFrame) -> DataFrame:
    """Entries that unlock a skin: the log size reaches its threshold (not the free one)."""
    skins = skins_table(log.sparkSession).filter("threshold > 0")
    return numbered(log).join(F.broadcast(skins), F.col("rn") == F.col("threshold")).select("user_key", "event_id", "ts", "skin", "threshold")


def collected_cantons(log: DataFrame) -> DataFrame:
    """(user_key, cantons, n_cantons) over each user's present log; users with an empty log are absent."""
    canton = F.when(F.col("is_hit"), F.nullif(F.col("canton").cast("string"), F.lit("")))
    return latest_log(log).groupBy("user_key").agg(F.sort_array(F.collect_set(canton)).alias("cantons"), F.count_distinct(canton).alias("n_cantons"))


def skins_unlocked(count: Column) -> Column:
    """How many skins a log of that size has unlocked."""
    out = F.lit(0)
    for _, threshold in C.SKINS:
        out = out + (count >= threshold).cast("int")
    return out


def user_properties(log: DataFrame) -> DataFrame:
    """(user_key, throw_count, cantons_collected, dart_skins_unlocked) of every user seen in the log, cleared logs included."""
    now = latest_log(log).groupBy("user_key").agg(F.count("*").alias("throws"), F.count_distinct(F.when(F.col("is_hit"), F.nullif(F.col("canton").cast("string"), F.lit("")))).alias("cantons"))
    users = log.select("user_key").distinct().join(now, "user_key", "left")
    throws = F.coalesce("throws", F.lit(0))
    return users.select("user_key", throws.alias("throw_count"), F.coalesce("cantons", F.lit(0)).alias("cantons_collected"), skins_unlocked(throws).alias("dart_skins_unlocked"))


def user_properties_over_time(log: DataFrame, n: int = C.LOG_SIZE) -> DataFrame:
    """Properties after every change of the log, clears included.

    Cantons are counted as in ``canton_milestones``, by the running sum of the few entries at which
    one comes into the log of ``n`` or drops out of it.
    """
    rows = numbered(log).withColumn("seen", F.when(F.col("is_hit"), F.nullif(F.col("canton").cast("string"), F.lit(""))))
    same = Window.partitionBy("user_key", "epoch", "seen").orderBy("rn")
    rows = rows.withColumns({"since": F.col("rn") - F.lag("rn").over(same), "until": F.lead("rn").over(same) - F.col("rn")})
    far = lambda c: F.col("seen").isNotNull() & (F.col(c).isNull() | (F.col(c) > n))
    change = lambda at, by, own: F.struct(at.cast("long").alias("at"), F.lit(by).alias("by"), F.lit(own).alias("own"))
    rn = F.col("rn")
    steps = F.array_compact(F.array(change(rn, 0, 1), F.when(far("since"), change(rn, 1, 0)), F.when(far("until"), change(rn + n, -1, 0))))
    running = Window.partitionBy("user_key", "epoch").orderBy("s.at", "s.own", "rn").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.select("user_key", "epoch", "event_id", "ts", "rn", F.explode(steps).alias("s")).withColumn("cantons", F.sum("s.by").over(running)).filter("s.own = 1")
    entries = counted.select("user_key", "event_id", "ts", F.least(rn, F.lit(n)).cast("long").alias("throws"), F.col("cantons").cast("long").alias("cantons"))
    none = F.lit(0).cast("long")
    every = entries.unionByName(log.filter("is_clear").select("user_key", "event_id", "ts", none.alias("throws"), none.alias("cantons")))
    return every.select("user_key", "event_id", "ts", F.col("throws").alias("throw_count"), F.col("cantons").alias("cantons_collected"), skins_unlocked(F.col("throws")).alias("dart_skins_unlocked"))


def stamp_card(log: DataFrame, cantons: DataFrame) -> DataFrame:
    """Every user with every canton of ``cantons`` (canton): collected or not, and how many, and whether all.

    Users without an entry in the present log have a card of blanks. The product is by design: one
    row a user and canton, from a table of at most MOST_CANTONS.
    """
    users = log.select("user_key").distinct()
    have = latest_log(log).filter("is_hit").select("user_key", F.col("canton").cast("string").alias("canton")).distinct().withColumn("collected", F.lit(True))
    total = cantons.limit(MOST_CANTONS + 1).count()
    if total > MOST_CANTONS:
        raise ValueError(f"a card has at most {MOST_CANTONS} cantons")
    grid = users.withColumn("canton", F.explode(F.array(*[F.lit(r["canton"]) for r in cantons.orderBy("canton").collect()]))) if total else users.limit(0).withColumn("canton", F.lit(""))
    card = grid.join(have, ["user_key", "canton"], "left").withColumn("collected", F.coalesce("collected", F.lit(False)))
    n = F.sum(F.col("collected").cast("int")).over(Window.partitionBy("user_key"))
    return card.withColumn("n_collected", n).withColumn("complete", F.col("n_collected") == total)


def internal_flag(hits: DataFrame, device: str = "user_id", value: str = "internal_value", order: tuple[str, ...] = ("ts", "hit_id"), include_current: bool = False) -> DataFrame:
    """Hits with ``internal``: the device's last '1' or '0' before the hit (or up to it) was '1'."""
    w = Window.partitionBy(device).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    last = F.last(F.when(F.col(value).isin("1", "0"), F.col(value)), ignorenulls=True).over(w)
    return hits.withColumn("internal", F.coalesce(last == "1", F.lit(False)))


def settings_as_of(changes: DataFrame, keys: dict[str, str] = C.DEFAULT_SETTINGS) -> DataFrame:
    """(user_key, ts, event_id, key, value) changes to all settings after each, defaults where never set."""
    w = Window.partitionBy("user_key").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return changes.select("user_key", "ts", "event_id", *[F.coalesce(F.last(F.when(F.col("key") == k, F.col("value")), ignorenulls=True).over(w), F.lit(d)).alias(k) for k, d in keys.items()])


def first_engagement(rows: DataFrame, session: str = "session_id", instance: str = "instance") -> DataFrame:
    """The first row of each session and map instance."""
    w = Window.partitionBy(session, instance).orderBy(*_ORDER)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
