"""Windows over ranges of large groups equal those over whole groups; one group of all rows is many tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from placestream.operators import logs, segments, telemetry


def samples(spark, n=3_000):
    """Most rows are of one host: bursts, rests, equal times; others of small hosts, of none, or without a time."""
    rng, rows = random.Random(2), []
    for i in range(n):
        at = rng.choice([rng.randrange(10_000), 5_000, rng.randrange(10**9), 10**9 + rng.randrange(50)])
        host = rng.choice(["hot", "hot", "hot", "hot", None, f"h{rng.randrange(40)}"])
        rows.append((i, host, None if i % 400 == 399 else at * 1_000, rng.randrange(100), rng.random() if rng.random() < 0.01 else None, rng.random() * 9, rng.random() * 9))
    return spark.createDataFrame(rows, "event_id long, host string, us long, ticks long, slow double, x double, y double").withColumn("ts", F.timestamp_micros("us")).drop("us").repartition(4)


@pytest.fixture(scope="module")
def table(spark):
    return samples(spark).cache()


def rows_of(df, *columns):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select("event_id", *columns).collect()), key=str)


@pytest.mark.parametrize("target", [5, 60])
def test_ranges_change_no_result(table, target):
    for name, run, columns in (
        ("rate", lambda t: telemetry.counter_rate(table, target=t), ("rate",)),
        ("rolling", lambda t: telemetry.rolling_samples(table, "ticks", 12, target=t), ("rolling_mean", "rolling_max", "rolling_n")),
        ("fill", lambda t: telemetry.forward_fill(table, "slow", target=t), ("filled",)),
        ("events", lambda t: telemetry.rolling_rate(table, "host", 60, target=t), ("n", "rate")),
        ("path", lambda t: telemetry.path_length(table, "host", target=t), ("distance", "dt", "speed")),
    ):
        assert rows_of(run(target), *columns) == rows_of(run(10**9), *columns), name


def test_whole_groups_are_as_defined(table):
    w = Window.partitionBy("host").orderBy("ts", "event_id")
    plain = table.withColumn("filled", F.last("slow", True).over(w)).withColumn("rolling_n", F.count("ticks").over(w.rowsBetween(-11, 0)))
    ours = telemetry.rolling_samples(telemetry.forward_fill(table, "slow", target=40), "ticks", 12, target=40)
    assert rows_of(ours, "filled", "rolling_n") == rows_of(plain, "filled", "rolling_n")
    assert ours.columns == [*table.columns, "filled", "rolling_mean", "rolling_max", "rolling_n"]


def test_one_host_is_many_small_tasks(spark):
    rows = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit("hot").alias("host"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("ticks"))
    parts, cut = segments.ranged(rows, "host", target=500)
    sizes = [r["count"] for r in parts.groupBy("_range").count().collect()]
    assert cut and len(sizes) == 40 and max(sizes) <= 1_000
    with_tails = segments.with_tails(rows, "host", back_rows=119, target=500)
    assert with_tails.filter("_tail").count() == 39 * 119
    assert with_tails.groupBy("_range").count().agg(F.max("count")).first()[0] <= 1_119
    assert telemetry.counter_rate(rows, target=500).filter("rate = 1").count() == 19_999
    near = segments.with_tails(rows, "host", ("ts",), back_micros=60_000_000, target=10)
    assert near.filter("_tail").count() < 25_000  # ranges are no shorter than what is looked back at


def test_ranges_are_bounded_in_number(spark, monkeypatch):
    monkeypatch.setattr(segments, "MOST_RANGES", 8)
    rows = spark.range(4_000).select(F.col("id").alias("event_id"), F.lit(1).alias("host"), F.timestamp_seconds("id").alias("ts"))
    assert segments.ranged(rows, "host", target=1)[0].select("_range").distinct().count() <= 16


def test_no_rows_and_one_time(spark):
    empty = spark.createDataFrame([], "event_id long, host string, ts timestamp, ticks long")
    assert telemetry.counter_rate(empty, target=1).count() == 0
    same = spark.range(50).select(F.col("id").alias("event_id"), F.lit("a").alias("host"), F.timestamp_seconds(F.lit(5)).alias("ts"), F.col("id").alias("ticks"))
    assert [r.rate for r in telemetry.counter_rate(same, target=1).orderBy("event_id").collect()] == [0.0] + [None] * 49


def test_a_hot_log_keeps_its_newest_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.randrange(300), rng.choice([True, *[False] * 60, None]), True, "BE") for i in range(900)]
    log = spark.createDataFrame(rows, "event_id long, user_key long, s long, is_clear boolean, is_hit boolean, canton string").withColumn("ts", F.timestamp_seconds("s"))
    want = {}
    for i, user, s, clear, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        want[user] = [] if clear else [*want.get(user, []), i]
    want = {u: x[-20:][::-1] for u, x in want.items() if x}
    got: dict = {}
    for r in logs.latest_log(log, 20).orderBy("place").collect():
        assert r.place == len(got.setdefault(r.user_key, [])) + 1
        got[r.user_key].append(r.event_id)
    assert got == want
    plan = logs.latest_log(log, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("WindowGroupLimit") == 2
