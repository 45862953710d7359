"""Every query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from placestream.plans import queries as places

from .compare import assert_same, duck


@pytest.mark.parametrize("name", sorted(places.ORACLES))
def test_query_matches_sql(spark, data_dir, name):
    ours = places.QUERIES[name](spark, data_dir).toPandas()
    assert_same(ours, duck(data_dir).sql(places.ORACLES[name]).df())


def test_entry_has_rows_and_every_oracle_has_a_query(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_have_no_products_and_no_python(spark, data_dir):
    for name, query in places.QUERIES.items():
        if name.startswith("stream_"):
            continue
        plan = query(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
        for node in ("CartesianProduct", "NestedLoop", "Python", "Pandas", "Arrow"):
            assert node not in plan, f"{name}: {node}"


def test_filters_reach_the_scan(spark, data_dir):
    plan = places.QUERIES["web_vitals"](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan
