"""Nearest catalog place of each point within a radius, as an equi-join on the cells of an adaptive grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placestream import constants as C
from placestream.functions.geo import haversine_km
from placestream.sources.tables import scratch

_KM_A_DEGREE = math.radians(1) * C.EARTH_RADIUS_KM
#: Points beyond this latitude have no cells (a degree of longitude shrinks to nothing).
MOST_LATITUDE = 85.0
#: Catalog size up to which it is broadcast.
BROADCAST_PLACES = 100_000
#: Places of a cell's list beyond which the cell is cut into four.
MOST_NEAR = 256
MOST_LEVELS = 24
#: Kilometres that roundings of distances may amount to.
_SLACK = 1e-5
_CELL = ["c_row", "c_col", "c_level", "c_u", "c_v"]
_PLACE = ["place_id", "name", "lat", "lon"]


def _height(radius_km: float) -> float:
    """Degrees of latitude of a cell, a little more than the radius."""
    return radius_km / _KM_A_DEGREE * 1.0001


def _row(lat, height: float):
    return F.floor(lat / height)


def _width(row, height: float):
    """Degrees of longitude of the cells of a grid row: wide enough for the radius at the row's far edge and its neighbours'."""
    edge = F.least(F.greatest(F.abs(row - 1), F.abs(row + 2)) * height, F.lit(89.0))
    return F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(math.radians(height))) / F.cos(F.radians(edge)))))


def nearest_place(points: DataFrame, places: DataFrame, radius_km: float = C.NEAR_KM, bull_km: float = C.BULLSEYE_KM, broadcast_places: int = BROADCAST_PLACES, most: int = MOST_NEAR) -> DataFrame:
    """``points`` (lat, lon, ...) with place_id, place_name, place_km and bullseye.

    Of the places (place_id, name, lat, lon) within ``radius_km`` (inclusive) the nearest wins, on
    equal distance the least place_id. Points without a place, or with a null coordinate or one
    beyond MOST_LATITUDE, keep null columns. A point meets one row, the list of its own cell, which
    has at most about ``most`` places however dense they are. With a catalog of at most
    ``broadcast_places`` (counted first) the points are not shuffled; a larger one is joined by cell.
    """
    height = _height(radius_km)
    small = places.limit(broadcast_places + 1).count() <= broadcast_places
    near = _near(points, places.select(*_PLACE), height, 1, most, small)
    measured = F.transform("_near", lambda p: F.struct(haversine_km("lat", "lon", p["lat"], p["lon"]).alias("km"), p["place_id"].alias("place_id"), p["name"].alias("name")))
    found = near.withColumn("_best", F.array_min(F.filter(measured, lambda p: p["km"] <= radius_km)))
    return found.select(*[F.col(f"`{c}`") for c in points.columns], F.col("_best.place_id").alias("place_id"), F.col("_best.name").alias("place_name"), F.col("_best.km").alias("place_km"), (F.col("_best.km") <= bull_km).alias("bullseye"))


def place_isolation(places: DataFrame, radius_km: float = 100.0, most: int = MOST_NEAR, broadcast_places: int = BROADCAST_PLACES) -> DataFrame:
    """(place_id, nearest_id, km): each place's nearest other place within a radius, null beyond it; the least id on ties.

    Every place looks into the list of its own cell, which holds the two nearest of every spot of the
    cell, so no pairs of places are made.
    """
    height = _height(radius_km)
    small = places.limit(broadcast_places + 1).count() <= broadcast_places
    near = _near(places.select("place_id", "lat", "lon"), places.select("place_id", F.lit(None).cast("string").alias("name"), "lat", "lon"), height, 2, most, small)
    measured = F.transform("_near", lambda p: F.struct(haversine_km("lat", "lon", p["lat"], p["lon"]).alias("km"), p["place_id"].alias("place_id")))
    best = F.array_min(F.filter(measured, lambda p: (p["km"] <= radius_km) & (p["place_id"] != F.col("place_id"))))
    return near.withColumn("_best", best).select("place_id", F.col("_best.place_id").alias("nearest_id"), F.col("_best.km").alias("km"))


def _near(points: DataFrame, places: DataFrame, height: float, nearest: int, most: int, small: bool) -> DataFrame:
    """Points with ``_near``, the list of their cell: all places that can be among the ``nearest`` of a spot in it."""
    located = own_cell(points, height)
    lists, cut = near_lists(located.select("lat", "lon", "c_row", "c_col"), places, height, nearest, most)
    hint = F.broadcast if small else (lambda df: df)
    located = located.withColumn("c_col", F.coalesce("c_col", -F.pmod(F.monotonically_increasing_id(), F.lit(997)) - 1))  # points without a cell do not meet in one key
    if cut is None:
        return located.join(hint(lists.drop("c_level", "c_u", "c_v")), ["c_row", "c_col"], "left")
    # a point of a cut cell looks at each level with lists there, and finds itself in exactly one
    located = located.join(hint(cut), ["c_row", "c_col"], "left").withColumn("c_level", F.explode(F.coalesce("c_levels", F.array(F.lit(0)))))
    located = located.withColumns({c: F.coalesce(x, F.lit(0)) for c, x in _part_of(F.col("c_level"), height).items()})
    return located.join(hint(lists), _CELL, "left").filter(F.col("_near").isNotNull() | F.col("c_levels").isNull())


def _part_of(level: Column, height: float) -> dict[str, Column]:
    """Where in its cell, cut ``level`` times, a point (lat, lon) lies."""
    scale = F.pow(F.lit(2.0), level).cast("long")
    part = lambda x: F.least(F.floor((x - F.floor(x)) * scale), scale - 1)
    return {"c_u": part(F.col("lat") / height), "c_v": part((F.col("lon") + 180) / _lon_step(height))}


def near_lists(points: DataFrame, places: DataFrame, height: float, nearest: int = 1, most: int = MOST_NEAR) -> tuple[DataFrame, DataFrame | None]:
    """Lists of places by cell, and the levels (c_row, c_col, c_levels) of the cells that were cut; none if no cell was.

    A cell lists the places in and around it. Where these are more than ``most``, it is cut into four,
    and again, wherever one of the ``points`` (lat, lon, c_row, c_col) lies; a part keeps the places that
    can be among the ``nearest`` of a spot in it. Of places at one spot only the ``nearest`` with the
    least ids are kept.
    """
    at_spot = Window.partitionBy("lat", "lon").orderBy("place_id")
    spots = places.filter(F.abs("lat") <= MOST_LATITUDE + 1).withColumn("_place", F.row_number().over(at_spot)).filter(F.col("_place") <= nearest).drop("_place")
    pairs = ring_around(spots, height).withColumns({"c_level": F.lit(0), "c_u": F.lit(0).cast("long"), "c_v": F.lit(0).cast("long")})
    place = F.collect_list(F.struct(*_PLACE)).alias("_near")
    dense = pairs.groupBy(*_CELL).count().filter(F.col("count") > most)
    if dense.isEmpty():
        return pairs.groupBy(*_CELL).agg(place), None
    spark, folder = places.sparkSession, scratch(places.sparkSession)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    first = kept(dense.select(*_CELL), "dense-0")
    base = ["c_row", "c_col"]
    lists = kept(pairs.join(first, _CELL, "left_anti").groupBy(*_CELL).agg(place), "lists-0")
    here = kept(points.join(first.select(*base), base, "left_semi").select("lat", "lon", *base).distinct(), "points")
    rest, level = pairs.join(first, _CELL, "left_semi"), 0
    while True:
        level += 1
        met = here.select(*base, F.lit(level).alias("c_level"), *[x.alias(c) for c, x in _part_of(F.lit(level), height).items()]).distinct()
        pairs = kept(_parts(rest, met, level, height, nearest), f"level-{level}")
        dense = kept(pairs.groupBy(*_CELL).count().filter((F.col("count") > most) & F.lit(level < MOST_LEVELS)).select(*_CELL), f"dense-{level}")
        lists = lists.unionByName(pairs.join(dense, _CELL, "left_anti").groupBy(*_CELL).agg(place))
        if dense.isEmpty():
            break
        rest = pairs.join(dense, _CELL, "left_semi")
    lists = kept(lists, "lists")
    levels = lists.filter("c_level > 0").groupBy(*base).agg(F.sort_array(F.collect_set("c_level")).alias("c_levels"))
    return lists, levels


def _lon_step(height: float) -> Column:
    return 360 / F.floor(360 / _width(F.col("c_row"), height))


def _chord(km: Column) -> Column:
    return 2 * C.EARTH_RADIUS_KM * F.sin(km / (2 * C.EARTH_RADIUS_KM))


def _parts(pairs: DataFrame, met: DataFrame, level: int, height: float, nearest: int) -> DataFrame:
    """The parts of each cell that are ``met`` by a point, with the places that can be among the nearest of a spot in them.

    Let c be a part's centre and r its radius, p a place and q one near c, all as points in space. How much
    farther, squared, a spot x is from p than from q is linear in x, so in the part it is at least
    |c-p|² - |c-q|² - 2 r |p-q|. Where that is positive for ``nearest`` places q, p is left out.
    """
    four = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    parts = pairs.withColumn("_at", four).withColumns({"c_level": F.lit(level), "c_u": F.col("c_u") * 2 + F.col("_at.a"), "c_v": F.col("c_v") * 2 + F.col("_at.b")}).drop("_at").join(met, _CELL, "left_semi")
    scale, step = float(1 << level), _lon_step(height)
    lat, lon = (F.col("c_row") + (F.col("c_u") + 0.5) / scale) * height, (F.col("c_col") + (F.col("c_v") + 0.5) / scale) * step - 180
    half_lat, half_lon = height / scale / 2, step / scale / 2
    parts = parts.withColumn("_d", haversine_km("lat", "lon", lat, lon))
    near = F.struct("_d", "lat", "lon", "place_id")
    if nearest == 1:
        bound = F.array(F.min(near))
    else:  # of eight groups of places by a hash, the least are different places
        group = F.pmod(F.xxhash64("place_id"), F.lit(8))
        bound = F.slice(F.sort_array(F.array_compact(F.array(*[F.min(F.when(group == i, near)) for i in range(8)]))), 1, nearest)
    bounds = parts.groupBy(*_CELL).agg(bound.alias("_bound"))
    radius = F.greatest(haversine_km(lat, lon, lat - half_lat, lon + half_lon), haversine_km(lat, lon, lat + half_lat, lon + half_lon))
    joined = parts.join(bounds, _CELL).withColumn("_r", _chord(radius) + _SLACK)
    apart = lambda q: _chord(haversine_km("lat", "lon", q["lat"], q["lon"]))
    farther = lambda q: F.pow(_chord(F.col("_d")), F.lit(2)) - F.pow(_chord(q["_d"]), F.lit(2)) > 2 * F.col("_r") * apart(q) + _SLACK
    left_out = (F.size("_bound") >= nearest) & F.forall("_bound", farther)
    return joined.filter(~left_out).select(*_CELL, *_PLACE)


def own_cell(rows: DataFrame, height: float) -> DataFrame:
    """Rows (lat, lon) with their own grid cell (c_row, c_col); null beyond MOST_LATITUDE."""
    n = F.floor(360 / _width(F.col("c_row"), height))
    return rows.withColumn("c_row", F.when(F.abs("lat") <= MOST_LATITUDE, _row(F.col("lat"), height))).withColumn("c_col", F.pmod(F.floor((F.col("lon") + 180) / (360 / n)), n))


def ring_around(places: DataFrame, height: float) -> DataFrame:
    """Places with each of the grid cells in and around their own."""
    rows = places.withColumn("c_row", F.explode(F.array(*[_row(F.col("lat"), height) + d for d in (-1, 0, 1)])))
    n = F.floor(360 / _width(F.col("c_row"), height))
    own = F.floor((F.col("lon") + 180) / (360 / n))
    return rows.withColumn("c_col", F.explode(F.array(*[F.pmod(own + d, n) for d in (-1, 0, 1)]))).distinct()
