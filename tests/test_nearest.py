"""Nearest places against all pairs where places are dense, equal, far apart or around the date line."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placestream.functions.geo import haversine_km
from placestream.operators import nearest

PLACES = "place_id long, name string, lat double, lon double"


def dense(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"p{i}", 47 + rng.random() * 0.03, 8 + rng.random() * 0.03) for i in range(n)]
    rows += [(n + i, "same", 47.01, 8.01) for i in range(40)]  # many at one spot
    rows += [(2 * n + i, "ring", 46.95 + 0.01 * math.cos(i), 8 + 0.01 * math.sin(i)) for i in range(60)]  # all as far from one point
    rows += [(3 * n + i, "far", -20 + rng.random() * 2, 179.5 + rng.random() if i % 2 else -179.5 - rng.random() * 0.5) for i in range(60)]
    return [(i, name, lat, lon - 360 if lon > 180 else lon) for i, name, lat, lon in rows]


def spots(n, seed=2):
    rng = random.Random(seed)
    rows = [(i, 46.9 + rng.random() * 0.2, 7.9 + rng.random() * 0.2) for i in range(n)]
    rows += [(n, 46.95, 8.0), (n + 1, 47.01, 8.01), (n + 2, None, 8.0), (n + 3, 89.0, 8.0), (n + 4, 10.0, 10.0)]
    return rows + [(n + 10 + i, -20 + rng.random() * 2, -180 + rng.random() * 0.3 if i % 2 else 180 - rng.random() * 0.3) for i in range(40)] + [(n + 60, -19.0, 180.0), (n + 61, -19.0, -180.0)]


@pytest.mark.parametrize("small", [0, 10**6])
def test_nearest_in_dense_cells_is_that_of_all_pairs(spark, small):
    places, points = spark.createDataFrame(dense(1_500), PLACES), spark.createDataFrame(spots(400), "id long, lat double, lon double")
    km = haversine_km("a.lat", "a.lon", "b.lat", "b.lon")
    pairs = points.alias("a").crossJoin(places.alias("b")).select("a.id", km.alias("km"), "b.place_id").filter("km <= 8")
    want = {r.id: (r.b.place_id, round(r.b.km, 9)) for r in pairs.groupBy("id").agg(F.min(F.struct("km", "place_id")).alias("b")).collect()}
    found = nearest.nearest_place(points, places, broadcast_places=small, most=40).collect()
    assert sorted(r.id for r in found) == sorted(r[0] for r in spots(400))
    got = {r.id: (r.place_id, round(r.place_km, 9)) for r in found if r.place_id is not None}
    assert got.keys() == want.keys() and len(want) > 350
    assert all(abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    assert sum(got[k][0] != want[k][0] for k in want) == 0


def test_isolation_in_dense_cells_is_that_of_all_pairs(spark):
    rows = dense(600)
    places = spark.createDataFrame(rows, PLACES)
    km = haversine_km("a.lat", "a.lon", "b.lat", "b.lon")
    pairs = places.alias("a").crossJoin(places.alias("b")).filter("a.place_id <> b.place_id").select("a.place_id", km.alias("km"), F.col("b.place_id").alias("other")).filter("km <= 20")
    want = {r.place_id: (r.b.other, r.b.km) for r in pairs.groupBy("place_id").agg(F.min(F.struct("km", "other")).alias("b")).collect()}
    got = {r.place_id: (r.nearest_id, r.km) for r in nearest.place_isolation(places, 20.0, most=16).collect()}
    assert got.keys() == {r[0] for r in rows}
    assert all(got[k] == (None, None) if k not in want else got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_lists_are_bounded_and_joined_by_cell(spark):
    rng = np.random.default_rng(3)
    xy = rng.random((20_000, 2)) * 0.05 + [47.0, 8.0]
    places = spark.createDataFrame([(i, "p", float(a), float(b)) for i, (a, b) in enumerate(xy)], PLACES)
    points = spark.createDataFrame([(i, 46.93 + i / 3_000, 7.93 + (7 * i % 400) / 2_000) for i in range(400)], "id long, lat double, lon double")
    height = nearest._height(8.0)
    lists, cut = nearest.near_lists(nearest.own_cell(points, height), places, height, most=64)
    sizes = lists.filter("c_level > 0").select(F.size("_near").alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert sizes[0] <= 64 and sizes[1] < 64 * 400 and cut.count() > 1
    plan = nearest.nearest_place(points, places, broadcast_places=0, most=64)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
