"""Coordinates to places: validation, snapped cells, municipality and elevation lookups, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placestream import constants as C
from placestream.functions.geo import bearing_deg, compass_sector, haversine_km, in_bbox, snap_to_grid
from placestream.functions.text import is_water


def validation_reason(lat: Column, lon: Column) -> Column:
    """Why a coordinate pair given as text is refused, in order of the checks; null if it is good."""
    number = r"^[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|Infinity|NaN)$"
    a, b = lat.try_cast("double"), lon.try_cast("double")
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        F.when(~(F.coalesce(lat.rlike(number), F.lit(False)) & F.coalesce(lon.rlike(number), F.lit(False))) | a.isNull() | b.isNull(), "not_numbers")
        .when(~(finite(a) & finite(b)), "not_finite")
        .when(~(a.between(-90, 90) & b.between(-180, 180)), "out_of_range")
    )


def validate_points(raw: DataFrame) -> DataFrame:
    """``raw`` (lat, lon as text) with numeric lat and lon, null where refused, and the reason."""
    reason = validation_reason(F.col("lat"), F.col("lon"))
    good = lambda c: F.when(F.col("reason").isNull(), F.col(c).try_cast("double"))
    return raw.withColumn("reason", reason).withColumns({"lat": good("lat"), "lon": good("lon")})


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reason)."""
    checked = validate_points(raw)
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")


def snapped(points: DataFrame) -> DataFrame:
    """Points with s_lat and s_lon on the lookup grid, km and direction from the origin."""
    lat, lon = C.ORIGIN
    s = points.withColumns({"s_lat": snap_to_grid("lat"), "s_lon": snap_to_grid("lon")})
    return s.withColumns({"km": haversine_km(lat, lon, "s_lat", "s_lon"), "direction": compass_sector(bearing_deg(lat, lon, "s_lat", "s_lon"))})


def distinct_cells(points: DataFrame, known: DataFrame | None = None, now: Column | None = None, days: int = C.CELL_DAYS) -> DataFrame:
    """Snapped cells to look up, each once: inside the box and not in ``known`` (s_lat, s_lon, fetched_at) of the last ``days``."""
    cells = points.select(snap_to_grid("lat").alias("s_lat"), snap_to_grid("lon").alias("s_lon")).filter(in_bbox("s_lat", "s_lon")).distinct()
    if known is None:
        return cells
    fresh = known.filter(F.col("fetched_at") >= (now if now is not None else F.current_timestamp()) - F.expr(f"interval {days} days"))
    return cells.join(fresh.select("s_lat", "s_lon").distinct(), ["s_lat", "s_lon"], "left_anti")


def parse_candidates(responses: DataFrame) -> DataFrame:
    """Lookup responses (s_lat, s_lon, body) to one row a candidate with its position; none gives a null position."""
    kind = "struct<results: array<struct<attributes: struct<gemname: string, kanton: string, gde_nr: int, is_current_jahr: boolean>>>>"
    parsed = responses.select("s_lat", "s_lon", F.posexplode_outer(F.from_json("body", kind)["results"]).alias("pos", "r"))
    return parsed.select("s_lat", "s_lon", "pos", F.col("r.attributes.gemname").alias("name"), F.col("r.attributes.kanton").alias("canton"), F.col("r.attributes.gde_nr").alias("place_no"), F.col("r.attributes.is_current_jahr").alias("is_current"))


def resolve_cells(candidates: DataFrame) -> DataFrame:
    """One row a cell: its first current candidate decides; without a name, or without one, it is border water."""
    first = F.min_by(F.struct("name", "canton"), F.when(F.col("is_current"), F.col("pos")))
    cells = candidates.groupBy("s_lat", "s_lon").agg(first.alias("f"), F.count("pos").alias("n"))
    has = F.coalesce(F.nullif(F.col("f.name"), F.lit("")).isNotNull(), F.lit(False))
    return cells.select("s_lat", "s_lon", F.when(F.col("n") == 0, "abroad").when(has, "hit").otherwise("border_water").alias("outcome"), F.when(has, F.col("f.name")).alias("municipality"), F.when(has, F.coalesce("f.canton", F.lit(""))).alias("canton"))


def resolve_places(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """Points to hits and misses: outside the box or without a candidate abroad, else as their cell.

    ``candidates`` has a row per candidate of a cell (s_lat, s_lon, pos, name, canton, is_current).
    Columns added: outcome, municipality, canton, water.
    """
    joined = snapped(points).join(resolve_cells(candidates), ["s_lat", "s_lon"], "left")
    inside = in_bbox("s_lat", "s_lon")
    outcome = F.when(inside, F.coalesce("outcome", F.lit("abroad"))).otherwise("abroad")
    joined = joined.withColumn("outcome", outcome)
    hit = F.col("outcome") == "hit"
    return joined.withColumns({"municipality": F.when(hit, F.col("municipality")), "canton": F.when(hit, F.col("canton")), "water": F.when(hit, is_water("municipality"))})


def with_elevation(resolved: DataFrame, elevations: DataFrame) -> DataFrame:
    """Elevation (s_lat, s_lon, metres) of hits only; a failed lookup leaves null and keeps the row."""
    cells = elevations.select("s_lat", "s_lon", F.col("metres").alias("elevation"))
    hits = resolved.filter("outcome = 'hit'").join(cells, ["s_lat", "s_lon"], "left")
    return hits.unionByName(resolved.filter("outcome <> 'hit'"), allowMissingColumns=True)


def lookup_errors(lookups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered lookups, failed ones): a failure is never read as abroad."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return lookups.filter(ok), lookups.filter(~ok)


def _renamed(x: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), x)


def resolved_server_events(resolved: DataFrame, upstream_ms: str = "upstream_ms") -> DataFrame:
    """``throw_resolved_server`` events of resolved throws, with JSON params by the event's contract.

    Hits carry canton, water, distance in whole kilometres, direction and the elevation if there is
    one, misses their reason; both the time of the lookup in whole milliseconds.
    """
    hit = F.col("outcome") == "hit"
    params = F.struct(
        F.when(hit, C.OUTCOMES["hit"]).otherwise(C.OUTCOMES["miss"]).alias("art"), F.floor(F.col(upstream_ms) + 0.5).alias("upstream_ms"), F.when(hit, F.col("canton")).alias("kanton"), F.when(hit, F.col("water")).alias("wasser"),
        F.when(hit, F.floor(F.col("km") + 0.5)).alias("distanz_km"), F.when(hit, F.col("direction")).alias("richtig"), F.when(hit, F.col("elevation")).alias("hoechi"), F.when(~hit, _renamed(F.col("outcome"), C.MISS_REASONS)).alias("grund"),
    )
    return resolved.select("*", F.lit("throw_resolved_server").alias("name"), F.to_json(params).alias("params"))


def completed_events(resolved: DataFrame, style: str = "throw_style") -> DataFrame:
    """``throw_completed`` events with JSON params by the event's contract: six place fields for a hit, the reason for a miss.

    ``style`` is the column of the throw's style (``labels.throw_style``), which both carry.
    """
    hit = F.col("outcome") == "hit"
    fields = {"canton": "canton", "municipality": "municipality", "elevation": "elevation", "distance_km": "km", "bearing": "direction", "water": "water"}
    params = F.struct(
        F.when(hit, C.OUTCOMES["hit"]).otherwise(C.OUTCOMES["miss"]).alias("outcome"), _renamed(F.col(style), C.STYLES).alias("throw_quality"),
        *[F.when(hit, F.col(c)).alias(n) for n, c in fields.items()], F.when(~hit, _renamed(F.col("outcome"), C.MISS_REASONS)).alias("miss_reason"),
    )
    return resolved.select("*", F.lit("throw_completed").alias("name"), F.to_json(params).alias("params"))


def server_event(rows: DataFrame, kind: str, **fields: Column) -> DataFrame:
    """Rows as server events of one kind with JSON params of ``fields`` (absent where null)."""
    return rows.select("*", F.lit(kind).alias("name"), F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("params"))


