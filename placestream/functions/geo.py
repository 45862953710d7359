"""Columns for coordinates: rounding, distance, bearing, projections, boxes and heatmaps.

Null inputs give null. All are built-in expressions and stay inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from placestream import constants as C


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def round_half_up(x: Column | str, decimals: int = 0) -> Column:
    """Round with halves toward +infinity (floor(x + 0.5)), unlike Spark's round()."""
    f = float(10**decimals)
    return F.floor(_c(x) * f + 0.5) / f if decimals else F.floor(_c(x) + 0.5)


def snap_to_grid(x: Column | str) -> Column:
    """One coordinate on the lookup grid."""
    return round_half_up(x, C.GRID_DECIMALS)


def in_bbox(lat: Column | str, lon: Column | str, box: C.Box = C.BOX) -> Column:
    return _c(lat).between(box.south, box.north) & _c(lon).between(box.west, box.east)


def clamp_to_bbox(lat: Column | str, lon: Column | str, box: C.Box = C.BOX, margin: float = C.BOX_MARGIN) -> Column:
    """struct<lat, lon> moved into the box less a margin."""
    clamp = lambda x, low, high: F.least(F.greatest(_c(x), F.lit(low + margin)), F.lit(high - margin))
    return F.struct(clamp(lat, box.south, box.north).alias("lat"), clamp(lon, box.west, box.east).alias("lon"))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; the root is capped at 1, where rounding would leave asin undefined."""
    a, b = _c(lat1), _c(lat2)
    half = F.pow(F.sin(F.radians(b - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(b)) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * C.EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360)."""
    a, b, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    angle = F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return F.pmod(F.degrees(angle) + 360, F.lit(360.0))


def compass_sector(bearing: Column | str) -> Column:
    """One of eight names; a bearing between two sectors belongs to the one clockwise."""
    at = F.pmod(F.floor(_c(bearing) / 45 + 0.5), F.lit(8)).cast("int") + 1
    return F.element_at(F.array(*map(F.lit, C.SECTORS)), at)


def destination_point(lat, lon, km, bearing) -> Column:
    """struct<lat, lon> reached from a point after ``km`` on a great circle."""
    a, turn, far = F.radians(_c(lat)), F.radians(_c(bearing)), _c(km) / C.EARTH_RADIUS_KM
    to = F.asin(F.sin(a) * F.cos(far) + F.cos(a) * F.sin(far) * F.cos(turn))
    east = F.atan2(F.sin(turn) * F.sin(far) * F.cos(a), F.cos(far) - F.sin(a) * F.sin(to))
    return F.struct(F.degrees(to).alias("lat"), (_c(lon) + F.degrees(east)).alias("lon"))


# The published approximation from WGS84 to the Swiss grid, as (factor, power of
# the longitude's auxiliary value, power of the latitude's).
_EASTING = ((2600072.37, 0, 0), (211455.93, 1, 0), (-10938.51, 1, 1), (-0.36, 1, 2), (-44.54, 3, 0))
_NORTHING = ((1200147.07, 0, 0), (308807.95, 0, 1), (3745.25, 2, 0), (76.63, 0, 2), (-194.56, 2, 1), (119.79, 0, 3))


def wgs84_to_lv95(lat, lon) -> Column:
    """struct<easting, northing> in metres, within about 0.3 m inside Switzerland."""
    x, y = (_c(lon) * 3600 - 26782.5) / 10000, (_c(lat) * 3600 - 169028.66) / 10000

    def polynomial(terms):
        out = None
        for factor, i, j in terms:
            term = F.lit(factor)
            for _ in range(i):
                term = term * x
            for _ in range(j):
                term = term * y
            out = term if out is None else out + term
        return out

    return F.struct(polynomial(_EASTING).alias("easting"), polynomial(_NORTHING).alias("northing"))


class View:
    """A Web-Mercator view of ``width`` x ``height`` pixels that the box fills, less a padding."""

    def __init__(self, width: float = 1280, height: float = 800, padding: float = 24, box: C.Box = C.BOX):
        x = lambda lon: (lon + 180) / 360
        y = lambda lat: 0.5 - math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) / (2 * math.pi)
        self.width, self.height = float(width), float(height)
        self.scale = min((width - 2 * padding) / (x(box.east) - x(box.west)), (height - 2 * padding) / (y(box.south) - y(box.north)))
        self.mid_x, self.mid_y = (x(box.west) + x(box.east)) / 2, (y(box.north) + y(box.south)) / 2

    def pixel_to_point(self, px, py) -> Column:
        """struct<lat, lon> under a pixel."""
        x = self.mid_x + (_c(px) - self.width / 2) / self.scale
        y = self.mid_y + (_c(py) - self.height / 2) / self.scale
        lat = F.degrees(2 * F.atan(F.exp((0.5 - y) * (2 * math.pi)))) - 90
        return F.struct(lat.alias("lat"), (x * 360 - 180).alias("lon"))

    def point_to_pixel(self, lat, lon) -> Column:
        """struct<x, y> of the pixel over a point."""
        x = (_c(lon) + 180) / 360
        y = 0.5 - F.log(F.tan(F.radians(_c(lat)) / 2 + math.pi / 4)) / (2 * math.pi)
        return F.struct(((x - self.mid_x) * self.scale + self.width / 2).alias("x"), ((y - self.mid_y) * self.scale + self.height / 2).alias("y"))

    def km_per_px(self, lat) -> Column:
        return F.lit(2 * math.pi * C.EARTH_RADIUS_KM / self.scale) * F.cos(F.radians(_c(lat)))

    def valid_landing(self, px, py) -> Column:
        """Whether a pixel is on the map: a finite point, |lat| <= 90, that projects back within 2 px."""
        p = self.pixel_to_point(px, py)
        again = self.point_to_pixel(p["lat"], p["lon"])
        finite = ~F.isnan(p["lat"]) & ~F.isnan(p["lon"]) & (F.abs(p["lat"]) <= 90) & (F.abs(p["lon"]) < float("inf"))
        return F.coalesce(finite & (F.hypot(again["x"] - _c(px), again["y"] - _c(py)) <= C.LANDING_TOLERANCE_PX), F.lit(False))


def heatmap_bucket(x, size, buckets: int = C.HEATMAP_BUCKETS) -> Column:
    """Cell of a pixel in a row of ``buckets`` cells; pixels off the screen go to the edge."""
    return F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(_c(x) / _c(size) * buckets))).cast("int")
