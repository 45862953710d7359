"""Columns that name or grade: reactions, devices, drags, sensors, batteries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from placestream import constants as C

from .geo import _c

# Sensor key to label, prefix to group.
SENSOR_LABELS = {"TC0P": "CPU proximity", "TG0P": "GPU proximity", "TB0T": "Battery"}
SENSOR_GROUPS = {"TC": "CPU", "TG": "GPU", "TB": "Battery", "TM": "Memory", "T": "Other"}


def reaction_label(water, elevation, km, canton) -> Column:
    """Code of the most telling remark on a hit: water, then height, then distance, then canton."""
    e, d, c = _c(elevation), _c(km), _c(canton)
    return (
        F.when(_c(water), "water")
        .when(e >= 3500, "glacier").when(e >= 2500, "high_alpine").when(e >= 1500, "high").when(e <= 300, "low")
        .when(d <= 10, "close").when(d >= 200, F.concat(F.lit("far_"), F.floor(d + 0.5).cast("string")))
        .when(c.isin("ZH", "BE", "TI", "VS", "GR"), F.concat(F.lit("canton_"), c)).otherwise("other")
    )


def device_context(dark, fine, coarse, reduced_motion=None) -> Column:
    """struct<color_scheme, pointer_type, reduced_motion> from device flags; absent flags count as off."""
    on = lambda x: F.coalesce(_c(x), F.lit(False))
    return F.struct(F.when(on(dark), "dark").otherwise("light").alias("color_scheme"), F.when(on(fine), "fine").when(on(coarse), "coarse").otherwise("none").alias("pointer_type"), on(F.lit(None) if reduced_motion is None else reduced_motion).alias("reduced_motion"))


def canton_name(code) -> Column:
    """Display name of a canton; a code that is not known stays as it is."""
    names = F.create_map(*[F.lit(x) for pair in C.CANTONS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, _c(code)), _c(code))


def card_title(place, municipality, water) -> Column:
    """struct<title, verb>: place name, else municipality; in water or on land."""
    return F.struct(F.coalesce(_c(place), _c(municipality)).alias("title"), F.when(_c(water), "in_water").otherwise("on_land").alias("verb"))


def shown_direction(km, direction) -> Column:
    """The direction where the distance is large enough to speak of one."""
    return F.when(_c(km) >= C.DIRECTION_FROM_KM, _c(direction))


def log_label(is_hit, place, municipality, canton) -> Column:
    """struct<label, canton>: place or municipality with the canton's name, or the code 'miss'; a dash where there is no canton."""
    return F.struct(
        F.when(_c(is_hit), F.coalesce(_c(place), _c(municipality))).otherwise("miss").alias("label"),
        F.when(_c(is_hit) & (F.coalesce(_c(canton), F.lit("")) != ""), canton_name(canton)).otherwise("—").alias("canton"),
    )


def drag_length(dx, dy) -> Column:
    """Pixels of a drag as other engines compute them too; ``hypot`` is off by one place now and then, which tells at a limit."""
    return F.sqrt(_c(dx) * _c(dx) + _c(dy) * _c(dy))


def drag_features(x, y, dx, dy, style) -> Column:
    """struct<target_x, target_y, force, enough>: a drag pulled back aims the other way, a fling along it."""
    length = drag_length(dx, dy)
    way = F.when(_c(style).isin(*C.BACKWARD_STYLES), -C.DRAG_FACTOR).otherwise(C.DRAG_FACTOR)
    return F.struct(
        (_c(x) + _c(dx) * way).alias("target_x"), (_c(y) + _c(dy) * way).alias("target_y"),
        F.least(length / C.MAX_DRAG_PX, F.lit(1.0)).alias("force"), (length >= C.MIN_DRAG_PX).alias("enough"),
    )


def scatter_sigma(radius, force) -> Column:
    """Expected scatter in pixels."""
    return F.greatest(F.lit(C.SIGMA_LEAST_PX), _c(radius) * C.NOVICE_SIGMA * (C.SIGMA_LOW + _c(force) * (C.SIGMA_HIGH - C.SIGMA_LOW)))


def throw_style(shank, deviation, sigma) -> Column:
    """Style of a recorded throw; ``sigma`` already holds a shank's widening. The limit of a whole or decimal ``sigma`` is exact."""
    limit = _c(sigma) * F.lit(Decimal(str(C.SLOPPY_FACTOR)))
    return F.when(_c(shank), "shank").when(_c(deviation) > limit, "sloppy").otherwise("clean")


def drag_outcome(dx, dy) -> Column:
    """Event of a released drag; a press that never moved (null) gives none."""
    return F.when(_c(dx).isNull() | _c(dy).isNull(), "no_move").when(drag_length(dx, dy) < C.MIN_DRAG_PX, "throw_abandoned").otherwise("throw_input_method")


def scale_vital(name, value) -> Column:
    """Whole-number web vital; layout shift is counted in thousandths."""
    return F.floor(F.when(_c(name) == "CLS", _c(value) * 1000).otherwise(_c(value)) + 0.5).cast("long")


def plausible_sensor(key, value) -> Column:
    return _c(key).startswith("T") & _c(value).between(0, 150)


def sensor_label(key) -> Column:
    """Exact label, else the group of the longest known prefix, else the key."""
    exact = F.create_map(*[F.lit(x) for pair in SENSOR_LABELS.items() for x in pair])
    by_prefix = [F.when(_c(key).startswith(p), SENSOR_GROUPS[p]) for p in sorted(SENSOR_GROUPS, key=lambda p: (-len(p), p))]
    return F.coalesce(F.try_element_at(exact, _c(key)), *by_prefix, _c(key))


def pressure_level(active, wired, compressed, physical) -> Column:
    share = (_c(active) + _c(wired) + _c(compressed)) / F.nullif(_c(physical), F.lit(0))
    return F.when(share > 0.9, "critical").when(share > 0.75, "warning").when(share.isNotNull(), "normal")


def usage_band(share) -> Column:
    return F.when(_c(share) >= 0.9, "red").when(_c(share) >= 0.7, "orange").when(_c(share).isNotNull(), "green")


def masked_modifiers(flags) -> Column:
    """Modifier flags reduced to the four that matter."""
    return _c(flags).bitwiseAND(F.lit(C.MODIFIER_MASK))


def points_to_metres(points, width_points, width_mm) -> Column:
    """Screen points as metres by the screen's density, else by one fixed density."""
    density = F.nullif(_c(width_points), F.lit(0)) / F.nullif(_c(width_mm), F.lit(0)) * 1000
    return _c(points) / F.coalesce(density, F.lit(C.POINTS_PER_METRE))


def battery_health(nominal, maximum, design) -> Column:
    """Percent of the design capacity, at most 100; a maximum that is itself a percentage is not used."""
    full = F.coalesce(_c(nominal), F.when(_c(maximum) > 100, _c(maximum)))
    return F.least(F.lit(100.0), full / F.nullif(_c(design), F.lit(0)) * 100)


def device_kind(name) -> Column:
    n = F.lower(_c(name))
    return F.when(n.contains("keyboard"), "keyboard").when(n.contains("mouse"), "mouse").when(n.contains("trackpad"), "trackpad").when(n.contains("airpods") | n.contains("headphone"), "headphones").otherwise("other")
