from __future__ import annotations

import pytest

from placestream.llm import registry

from ..compare import assert_same, duck


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, data_dir, name):
    assert_same(registry.QUERIES[name](spark, data_dir).toPandas(), duck(data_dir).sql(registry.ORACLES[name]).df())


def test_there_is_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
