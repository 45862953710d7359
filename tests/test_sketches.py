"""Reports from sketches kept a day: exact while small, within their bounds beyond, days replaced one by one."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from placestream.operators import sketches


def rows(spark, n, users):
    rng = random.Random(1)
    data = [(i, rng.choice("ab"), rng.randrange(users), rng.gauss(0, 9) if rng.random() < 0.98 else None, rng.randrange(20)) for i in range(n)]
    df = spark.createDataFrame(data, "i long, g string, user_id long, v double, d int")
    return data, df.withColumn("ts", F.timestamp_seconds(F.col("d") * 86_400 + 5))


def test_large_groups_are_within_the_bounds(spark):
    data, df = rows(spark, 60_000, 30_000)
    got = sketches.quantiles(sketches.daily_values(df, ["g"], "v", accuracy=500), ["g"], {"p10": 0.1, "p50": 0.5, "p95": 0.95}, accuracy=500).collect()
    for r in got:
        v = sorted(x[3] for x in data if x[1] == r.g and x[3] is not None)
        assert r.n == len(v)
        for name, q in (("p10", 0.1), ("p50", 0.5), ("p95", 0.95)):
            assert abs(sum(x <= r[name] for x in v) / len(v) - q) < 0.01
    few = {r.g: r.users for r in sketches.users(sketches.daily_users(df, ["g"], lg=10), ["g"], lg=10).collect()}
    for g, n in few.items():
        true = len({x[2] for x in data if x[1] == g})
        assert abs(n - true) / true < 0.1
    exact = sketches.common_users(sketches.daily_users(df, ["g"]), [], F.col("g") == "a", F.col("g") == "b").first()
    a, b = ({x[2] for x in data if x[1] == g} for g in "ab")
    assert tuple(exact) == (len(a), len(b), len(a & b))


def test_days_are_replaced_one_by_one(spark, tmp_path):
    data, df = rows(spark, 2_000, 300)
    path = f"file://{tmp_path}/days"
    sketches.keep_days(sketches.daily_users(df.filter("d < 15"), ["g"]), path)
    sketches.keep_days(sketches.daily_users(df.filter("d >= 10"), ["g"]), path)
    days = sketches.between(sketches.kept_days(spark, path), "1970-01-03", "1970-01-18")
    got = {r.g: (r.n, r.users) for r in sketches.users(days, ["g"]).collect()}
    want = {g: (sum(x[1] == g and 2 <= x[4] <= 17 for x in data), len({x[2] for x in data if x[1] == g and 2 <= x[4] <= 17})) for g in "ab"}
    assert got == want
    plan = sketches.users(days, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_no_rows_no_groups(spark):
    empty = spark.createDataFrame([], "user_id long, v double, g string, ts timestamp")
    assert sketches.quantiles(sketches.daily_values(empty, ["g"], "v"), ["g"], {"x": 0.5}).collect() == []
    assert sketches.users(sketches.daily_users(empty, ["g"]), ["g"]).collect() == []
