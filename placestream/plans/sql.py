"""Pieces of DuckDB SQL that several oracles share, written from the definitions."""

from __future__ import annotations

from placestream import constants as C

LAT0, LON0 = C.ORIGIN


def km(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    return f"(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(({b_lat}) - ({a_lat})) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin(radians(({b_lon}) - ({a_lon})) / 2), 2)))))"


def bearing(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    d = f"radians(({b_lon}) - ({a_lon}))"
    return f"((degrees(atan2(sin({d}) * cos(radians({b_lat})), cos(radians({a_lat})) * sin(radians({b_lat})) - sin(radians({a_lat})) * cos(radians({b_lat})) * cos({d}))) + 360) % 360)"


def sector(b: str) -> str:
    return f"{list(C.SECTORS)}[(cast(floor({b} / 45 + 0.5) as int) % 8) + 1]"


def snap(x: str) -> str:
    return f"(floor({x} * 10000 + 0.5) / 10000)"


def in_box(lat: str, lon: str) -> str:
    b = C.BOX
    return f"({lat} between {b.south} and {b.north} and {lon} between {b.west} and {b.east})"


WATER = "(regexp_matches(municipality, '(?i)(see|seeli)$') or regexp_matches(municipality, '(?i)^(lac|lago|lej|lai)([^A-Za-z0-9_]|$)'))"

#: Points resolved to hits and misses, with elevation; needs f_points, f_candidates, f_elevations.
RESOLVED = f"""cells as (select lat as s_lat, lon as s_lon, count(pos) as n, arg_min(struct_pack(name := name, canton := canton), pos) filter (where is_current) as f from f_candidates group by lat, lon),
snapped as (select *, {snap('lat')} as s_lat, {snap('lon')} as s_lon from f_points),
measured as (select *, {km(str(LAT0), str(LON0), 's_lat', 's_lon')} as km, {sector(bearing(str(LAT0), str(LON0), 's_lat', 's_lon'))} as direction from snapped),
outcomes as (select m.*, case when not {in_box('m.s_lat', 'm.s_lon')} or c.n is null or c.n = 0 then 'abroad' when c.f.name is not null and c.f.name <> '' then 'hit' else 'border_water' end as outcome, c.f as f
  from measured m left join cells c on m.s_lat = c.s_lat and m.s_lon = c.s_lon),
named as (select * exclude (f), case when outcome = 'hit' then f.name end as municipality, case when outcome = 'hit' then coalesce(f.canton, '') end as canton from outcomes),
heights as (select distinct lat as h_lat, lon as h_lon, metres from f_elevations),
resolved as (select n.*, case when outcome = 'hit' then {WATER} end as water, case when outcome = 'hit' then metres end as elevation
  from named n left join heights on s_lat = h_lat and s_lon = h_lon)"""

LOG = """log as (select event_id, user_key, ts, is_clear, is_hit, cast(canton_id as varchar) as canton from f_log),
epochs as (select *, sum(is_clear::int) over (partition by user_key order by ts, event_id) as epoch from log),
entries as (select *, row_number() over (partition by user_key, epoch order by ts, event_id) as rn from epochs where not is_clear),
latest as (select * from (select *, row_number() over (partition by user_key order by ts desc, event_id desc) as place from epochs e where not is_clear
  and epoch = (select max(epoch) from epochs x where x.user_key = e.user_key)) where place <= 200)"""
