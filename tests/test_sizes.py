"""Queries over events of their own against their SQL: cases that the small tables do not have."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from placestream.operators import reports
from placestream.plans import queries as places

from .compare import assert_same

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def same_as_sql(spark, tmp_path):
    def check(name, events):
        columns = [f"cast({f.rsplit(' ', 1)[0]} as {f.rsplit(' ', 1)[1]})" for f in EVENTS.split(", ")]
        events.selectExpr(*columns).write.parquet(f"{tmp_path}/events.parquet")
        c = duckdb.connect()
        c.execute("set timezone = 'UTC'")
        c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        ours = places.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert_same(ours, c.sql(places.ORACLES[name]).df())
        return ours

    return check


def some_events(spark, ids, **columns):
    """Events of ``ids``, a minute apart, with the columns given as SQL over event_id."""
    rows = spark.createDataFrame([(i,) for i in ids], "event_id long") if not isinstance(ids, int) else spark.range(ids).withColumnRenamed("id", "event_id")
    default = {"ts": "timestamp_seconds(1704067200 + event_id * 60 % 2500000)", "user_id": "event_id % 5", "event_type": "'view'", "value": "cast(1 as double)", "props": "'{}'"}
    return rows.select("event_id", *[F.expr(sql).alias(name) for name, sql in (default | columns).items()])


def test_a_log_of_misses_has_no_cantons(spark, same_as_sql):
    ours = same_as_sql("collected_cantons", some_events(spark, [6, 12, 13, 18], user_id="case when event_id = 13 then 7 else 1 end"))
    assert sorted(ours["n_cantons"]) == [0, 1]


def test_drags_at_the_limits(spark, same_as_sql):
    ids = [60308, 175943, 460308, 324211, 326946, 26946, 626946, 4526946, 2226946, 1, 2, 3]
    ours = same_as_sql("drags", some_events(spark, ids, value="case when event_id % 10000 = 6946 then 121.9 else 10 end"))
    assert {"throw_abandoned", "throw_input_method"} <= set(ours["outcome"])


def test_quantiles_of_large_groups_are_exact(spark, same_as_sql):
    kinds = "case when event_id % 7 = 0 then null when event_id % 2 = 0 then 'view' else 'click' end"
    value = "case when event_id % 50 > 0 then round(pow(pmod(xxhash64(event_id), 100000) / 5000, 2), 2) end"
    same_as_sql("values_over_days", some_events(spark, 60_000, event_type=kinds, value=value))


def test_the_least_value_of_a_share(spark):
    rows = spark.range(100).selectExpr("id % 1 as g", "cast(id + 1 as double) as v")
    for q, want in ((0.0, 1.0), (0.55, 55.0), (0.551, 56.0), (1.0, 100.0)):
        assert reports.quantile(rows, ["g"], "v", q, "x", least=True).first().x == want


def test_more_users_than_a_sketch_keeps(spark, same_as_sql):
    kinds = "case event_id % 4 when 0 then 'view' when 1 then 'purchase' when 2 then null else 'error' end"
    same_as_sql("viewers_who_buy", some_events(spark, 300_000, user_id="case when event_id % 1000 > 0 then pmod(xxhash64(event_id), 150000) end", event_type=kinds))
