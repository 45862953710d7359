"""Device telemetry: counter rates, rolling windows, heatmaps, daily and hourly roll-ups, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reports import quantile, with_quantile
from .segments import TARGET_ROWS, micros, settled, with_tails

_ORDER = ("ts", "event_id")


def counter_rate(samples: DataFrame, host: str = "host", value: str = "ticks", target: int = TARGET_ROWS) -> DataFrame:
    """Samples with ``rate`` a second: 0 for a host's first sample, null after a reset or without time between."""
    w = Window.partitionBy(host, "_range").orderBy(*_ORDER)
    before, then = F.lag(value).over(w), F.lag("ts").over(w)
    seconds = micros("ts").cast("double") / 1e6 - micros(then).cast("double") / 1e6
    rate = F.when(F.row_number().over(w) == 1, 0.0).when((F.col(value) >= before) & (seconds > 0), (F.col(value) - before) / seconds)
    return settled(with_tails(samples, host, _ORDER, back_rows=1, target=target).withColumn("rate", rate))


def rolling_samples(samples: DataFrame, value: str, n: int = 120, host: str = "host", target: int = TARGET_ROWS) -> DataFrame:
    """Samples with mean and maximum of the last ``n`` ones, the present included."""
    w = Window.partitionBy(host, "_range").orderBy(*_ORDER).rowsBetween(-(n - 1), 0)
    rolling = {"rolling_mean": F.avg(value).over(w), "rolling_max": F.max(value).over(w), "rolling_n": F.count(value).over(w)}
    return settled(with_tails(samples, host, _ORDER, back_rows=n - 1, target=target).withColumns(rolling))


def forward_fill(samples: DataFrame, value: str, host: str = "host", target: int = TARGET_ROWS) -> DataFrame:
    """Samples with ``filled``: the last known value of a metric that is not sampled every time."""
    w = Window.partitionBy(host, "_range").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    parts = with_tails(samples, host, _ORDER, back_rows=1, known=F.col(value).isNotNull(), target=target)
    return settled(parts.withColumn("filled", F.last(value, ignorenulls=True).over(w)))


def rolling_rate(events: DataFrame, key: str, seconds: int = 60, per_word: float = 5.0, min_span: float | None = None, target: int = TARGET_ROWS) -> DataFrame:
    """Events with ``rate`` a minute over the last ``seconds``: count / span * 60 / 5; null below two events or without span.

    ``min_span`` puts a floor under the span of short bursts; none by default. No range of a key is
    shorter than ``seconds``, so a task holds what a key sends in about that time, or the target.
    """
    at = micros("ts")
    w = Window.partitionBy(key, "_range").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    span = (at - F.min(at).over(w)) / 1e6
    used = F.greatest(span, F.lit(float(min_span))) if min_span else span
    n = F.count("*").over(w)
    parts = with_tails(events, key, ("ts",), back_micros=seconds * 1_000_000, target=target)
    return settled(parts.withColumns({"n": n, "rate": F.when((n >= 2) & (span > 0), n / used * 60 / per_word)}))


def path_length(moves: DataFrame, key: str, min_dt: float = 0.0, target: int = TARGET_ROWS) -> DataFrame:
    """Positions (x, y) with the distance from the one before and the speed where 0 < dt < 1 s (and dt >= ``min_dt``)."""
    w = Window.partitionBy(key, "_range").orderBy(*_ORDER)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    dt = (micros("ts") - micros(F.lag("ts").over(w))) / 1e6
    parts = with_tails(moves, key, _ORDER, back_rows=1, target=target)
    return settled(parts.withColumns({"distance": step, "dt": dt, "speed": F.when((dt > 0) & (dt < 1) & (dt >= min_dt), step / dt)}))


def peak_report(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, 95th percentile and maximum, computed anew from rows rather than latched."""
    report = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("peak"))
    return with_quantile(report, quantile(rows, list(by), value, 0.95, "p95"), list(by)).select(*by, "mean", "p95", "peak")


def daily_summary(events: DataFrame) -> DataFrame:
    """Per day: keys, clicks by kind, scrolls, distance, first and last activity, active minutes, top speed.

    ``events`` has ts, kind (key, left_click, right_click, other_click, scroll, move), dx, dy, distance, speed.
    """
    kind = lambda k: F.count_if(F.col("kind") == k)
    scrolled = lambda c: F.sum(F.when(F.col("kind") == "scroll", F.abs(c)))
    return events.groupBy(F.to_date("ts").alias("date")).agg(
        kind("key").alias("keys"), kind("left_click").alias("left_clicks"), kind("right_click").alias("right_clicks"), kind("other_click").alias("other_clicks"),
        F.coalesce(scrolled("dx"), F.lit(0.0)).alias("scroll_x"), F.coalesce(scrolled("dy"), F.lit(0.0)).alias("scroll_y"), F.coalesce(F.sum("distance"), F.lit(0.0)).alias("distance"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct(F.date_trunc("minute", "ts")).alias("active_minutes"), F.max("speed").alias("top_speed"),
    )


def hourly_summary(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(F.count_if(F.col("kind") == "key").alias("keys"), F.count_if(F.col("kind").endswith("click")).alias("clicks"))


def app_usage(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("date"), "bundle_id").agg(F.count_if(F.col("kind") == "key").alias("keys"), F.count_if(F.col("kind").endswith("click")).alias("clicks"))


def mouse_heatmap(moves: DataFrame) -> DataFrame:
    return moves.groupBy(F.to_date("ts").alias("date"), "screen_id", "bucket_x", "bucket_y").agg(F.count("*").alias("n"))


def keyboard_heatmap(keys: DataFrame) -> DataFrame:
    return keys.groupBy(F.to_date("ts").alias("date"), "key_code", "modifier_flags").agg(F.count("*").alias("n"))


def key_glyphs(presses: DataFrame, layout: DataFrame) -> DataFrame:
    """Key presses with the glyph of their position in a layout table; unknown positions have none."""
    return presses.join(layout, ["layout", "key_code"], "left")


def merge_counters(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert of partial rows (keys, n, first_ts, mean, peak, seq): counts add, the first time stays, the mean of the latest replaces, peaks take the maximum."""
    rows = old.unionByName(new)
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max_by("mean", F.when(F.col("mean").isNotNull(), F.col("seq"))).alias("mean"), F.max("peak").alias("peak"), F.max("seq").alias("seq"))


def all_time_totals(days: DataFrame) -> DataFrame:
    return days.agg(F.sum("keys").alias("keys"), F.sum(F.col("left_clicks") + F.col("right_clicks") + F.col("other_clicks")).alias("clicks"), F.sum("distance").alias("distance"), F.count("*").alias("days"))


def outlier_days(days: DataFrame, peak: str, limit: float) -> DataFrame:
    """(days, share) with a peak above a limit."""
    over = F.coalesce(F.col(peak) > limit, F.lit(False))
    return days.agg(F.count_if(over).alias("days"), F.avg(over.cast("double")).alias("share"))


def hottest_sensor(readings: DataFrame) -> DataFrame:
    """Per host: the sensor with the highest reading (least name on ties), and the mean."""
    top = F.min(F.struct((-F.col("value")).alias("v"), "sensor"))
    return readings.groupBy("host").agg(top.alias("t"), F.avg("value").alias("mean")).select("host", F.col("t.sensor").alias("sensor"), (-F.col("t.v")).alias("value"), "mean")


def missing_stream_check(counts: DataFrame, least: int = 50) -> DataFrame:
    """Sources with more than ``least`` mouse events and not one key: their key stream is probably not permitted."""
    sums = counts.groupBy("source_id").agg(F.sum("mouse").alias("mouse"), F.sum("keys").alias("keys"))
    return sums.filter((F.col("mouse") > least) & (F.col("keys") == 0))


def top_per_group(rows: DataFrame, value: Column, k: int, *by: str, ties: str = "event_id") -> DataFrame:
    """The ``k`` rows of each group with the greatest value, least id first on ties."""
    w = Window.partitionBy(*by).orderBy(value.desc(), ties)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def export_samples(samples: DataFrame, path: str) -> None:
    """Samples as CSV files with a header."""
    samples.write.mode("overwrite").option("header", True).csv(path)
