"""Queries over the driver's tables: what they compute in Spark, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placestream import constants as C
from placestream.functions import geo, labels, text
from placestream.operators import hits as H
from placestream.operators import logs as L
from placestream.operators import nearest, points, quality, reports, telemetry
from placestream.sources.adapters import adapter
from placestream.sources.tables import scratch
from placestream.streaming import ordered, streams, upserts

from . import sql as S
from .registry import ORACLES, QUERIES, query, r6

# ---- points and places ------------------------------------------------------------------------


@query(
    f"""with p as (select event_id as point_id, {S.snap('lat')} as lat, {S.snap('lon')} as lon from f_points where {S.in_box(S.snap('lat'), S.snap('lon'))}),
pairs as (select p.point_id, f.place_id, f.name, {S.km('p.lat', 'p.lon', 'f.lat', 'f.lon')} as km from p, f_places f),
best as (select point_id, place_id, name, km from pairs where km <= 8 qualify row_number() over (partition by point_id order by km, place_id) = 1)
select p.point_id, p.lat, p.lon, round({S.km(str(S.LAT0), str(S.LON0), 'p.lat', 'p.lon')}, 6) as origin_km, {S.sector(S.bearing(str(S.LAT0), str(S.LON0), 'p.lat', 'p.lon'))} as direction,
 b.place_id, b.name as place_name, round(b.km, 6) as place_km, b.km <= 0.6 as bullseye from p left join best b using (point_id)""",
    "f_points", "f_places",
)
def point_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on the grid and there in the box, with distance and direction from the origin and the nearest place within 8 km."""
    rows = adapter(spark, sf_dir, "f_points").filter(geo.in_bbox("lat", "lon", C.BOX_BEFORE_SNAP))  # may reach the scan; the snapped point decides
    rows = rows.select(F.col("event_id").alias("point_id"), geo.snap_to_grid("lat").alias("lat"), geo.snap_to_grid("lon").alias("lon")).filter(geo.in_bbox("lat", "lon"))
    near = nearest.nearest_place(rows, adapter(spark, sf_dir, "f_places"))
    far = geo.haversine_km(*C.ORIGIN, "lat", "lon")
    return near.select("point_id", "lat", "lon", r6(far, "origin_km"), geo.compass_sector(geo.bearing_deg(*C.ORIGIN, "lat", "lon")).alias("direction"), "place_id", "place_name", r6("place_km", "place_km"), "bullseye")


@query(
    f"""select event_id, round(2600072.37 + 211455.93 * x - 10938.51 * x * y - 0.36 * x * y * y - 44.54 * x * x * x, 3) as easting,
 round(1200147.07 + 308807.95 * y + 3745.25 * x * x + 76.63 * y * y - 194.56 * x * x * y + 119.79 * y * y * y, 3) as northing,
 round({S.bearing(str(S.LAT0), str(S.LON0), 'lat', 'lon')}, 6) as bearing, round(least(greatest(lat, 45.818 + 0.05), 47.8085 - 0.05), 6) as c_lat, round(least(greatest(lon, 5.9559 + 0.05), 10.4921 - 0.05), 6) as c_lon,
 printf('%.4f,%.4f', {S.snap('lat')}, {S.snap('lon')}) as point_text, round(lat, 6) as back_lat, round(lon, 6) as back_lon, true as on_map,
 round(((lon + 180) / 360 - (west + east) / 2) * scale + 640, 6) as px, round((0.5 - ln(tan(radians(lat) / 2 + pi() / 4)) / (2 * pi()) - (south + north) / 2) * scale + 400, 6) as py
from (select *, (lon * 3600 - 26782.5) / 10000 as x, (lat * 3600 - 169028.66) / 10000 as y from f_points) p,
 (select *, least((1280 - 48) / (east - west), (800 - 48) / (south - north)) as scale from (select (5.9559 + 180) / 360 as west, (10.4921 + 180) / 360 as east,
  0.5 - ln(tan(radians(45.818) / 2 + pi() / 4)) / (2 * pi()) as south, 0.5 - ln(tan(radians(47.8085) / 2 + pi() / 4)) / (2 * pi()) as north))""",
    "f_points",
)
def geo_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swiss grid, bearing, clamping, text form, and the round trip through the map view."""
    rows = adapter(spark, sf_dir, "f_points")
    view = geo.View()
    px = view.point_to_pixel("lat", "lon")
    rows = rows.withColumns({"g": geo.wgs84_to_lv95("lat", "lon"), "c": geo.clamp_to_bbox("lat", "lon"), "px": px})
    back = view.pixel_to_point(F.col("px.x"), F.col("px.y"))
    return rows.select(
        "event_id", F.round("g.easting", 3).alias("easting"), F.round("g.northing", 3).alias("northing"), r6(geo.bearing_deg(*C.ORIGIN, "lat", "lon"), "bearing"), r6("c.lat", "c_lat"), r6("c.lon", "c_lon"),
        text.format_point(geo.snap_to_grid("lat"), geo.snap_to_grid("lon")).alias("point_text"), r6(back["lat"], "back_lat"), r6(back["lon"], "back_lon"), view.valid_landing(F.col("px.x"), F.col("px.y")).alias("on_map"), r6("px.x", "px"), r6("px.y", "py"),
    )


@query(
    """select event_id, (event_id % 300)::double as km, round(degrees(lat2), 6) as lat, round(7.4474 + degrees(atan2(sin(b) * sin(d) * cos(a), cos(d) - sin(a) * sin(lat2))), 6) as lon
from (select *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(b)) as lat2 from (select event_id, radians(46.948) as a, (event_id % 300) / 6371.0 as d, radians((event_id * 7) % 360) as b from events))"""
)
def destination_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points reached from the origin by distance and bearing."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 300).cast("double").alias("km"), ((F.col("event_id") * 7) % 360).cast("double").alias("turn"))
    p = geo.destination_point(*C.ORIGIN, "km", "turn")
    return e.select("event_id", r6("km", "km"), r6(p["lat"], "lat"), r6(p["lon"], "lon"))


@query(
    r"""with parsed as (select event_id, try_cast(lat as double) as a, try_cast(lon as double) as b, coalesce(regexp_matches(lat, '^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|Infinity|NaN)$') and regexp_matches(lon, '^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|Infinity|NaN)$'), false) as numbers from f_raw_points),
judged as (select *, case when not numbers then 'not_numbers' when isnan(a) or isinf(a) or isnan(b) or isinf(b) then 'not_finite' when a not between -90 and 90 or b not between -180 and 180 then 'out_of_range' end as reason from parsed)
select event_id, reason, round(case when reason is null then a end, 6) as lat, round(case when reason is null then b end, 6) as lon from judged""",
    "f_raw_points",
)
def validated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates given as text: refused ones with their first reason."""
    out = points.validate_points(adapter(spark, sf_dir, "f_raw_points"))
    return out.select("event_id", "reason", r6("lat", "lat"), r6("lon", "lon"))


@query(
    f"""select distinct {S.snap('lat')} as s_lat, {S.snap('lon')} as s_lon from f_points where {S.in_box(S.snap('lat'), S.snap('lon'))} and event_id % 4000 % 3 <> 0""",
    "f_points",
)
def cells_to_look_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct cells inside the box that no recent lookup has answered."""
    rows = adapter(spark, sf_dir, "f_points")
    known = adapter(spark, sf_dir, "f_cells").filter("k % 3 = 0").select(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), F.current_timestamp().alias("fetched_at"))
    return points.distinct_cells(rows, known)


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = adapter(spark, sf_dir, "f_candidates").withColumnsRenamed({"lat": "s_lat", "lon": "s_lon"})
    heights = adapter(spark, sf_dir, "f_elevations").select(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "metres").distinct()
    return points.with_elevation(points.resolve_places(adapter(spark, sf_dir, "f_points"), candidates), heights)


_RESOLVE_IN = ("f_points", "f_candidates", "f_elevations")


@query(f"with {S.RESOLVED} select event_id, outcome, municipality, canton, water, elevation, round(km, 6) as km, direction from resolved", *_RESOLVE_IN)
def resolved_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to hits and misses with elevation."""
    return _resolved(spark, sf_dir).select("event_id", "outcome", "municipality", "canton", "water", "elevation", r6("km", "km"), "direction")


@query(
    f"""with {S.RESOLVED} select event_id,
 case when water then 'water' when elevation >= 3500 then 'glacier' when elevation >= 2500 then 'high_alpine' when elevation >= 1500 then 'high' when elevation <= 300 then 'low' when km <= 10 then 'close'
  when km >= 200 then 'far_' || cast(cast(floor(km + 0.5) as bigint) as varchar) when canton in ('ZH', 'BE', 'TI', 'VS', 'GR') then 'canton_' || canton else 'other' end as label,
 case canton when 'ZH' then 'Züri' when 'BE' then 'Bärn' else canton end as canton_name,
 concat_ws('  ·  ', nullif(canton, ''), elevation || ' m', cast(floor(km + 0.5) as bigint) || ' km') as line, case when km >= 2 then direction end as direction, municipality as title,
 case when water then 'in_water' else 'on_land' end as verb, municipality as log_label
from resolved where outcome = 'hit'""",
    *_RESOLVE_IN,
)
def hit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remark, canton name, card and log labels of hits."""
    h = _resolved(spark, sf_dir).filter("outcome = 'hit'")
    title = labels.card_title(F.lit(None).cast("string"), "municipality", "water")
    return h.select(
        "event_id", labels.reaction_label("water", "elevation", "km", "canton").alias("label"), labels.canton_name("canton").alias("canton_name"), text.card_line("canton", "elevation", "km").alias("line"),
        labels.shown_direction("km", "direction").alias("direction"), title["title"].alias("title"), title["verb"].alias("verb"), labels.log_label(F.lit(True), F.lit(None).cast("string"), "municipality", "canton")["label"].alias("log_label"),
    )


@query(
    f"""with {S.RESOLVED} select event_id, case when outcome = 'hit' then coalesce(case when event_id % 5 = 0 then 'Place ' || event_id end, municipality) else 'miss' end as label,
 case when outcome <> 'hit' or canton = '' then '—' when canton = 'ZH' then 'Züri' when canton = 'BE' then 'Bärn' else canton end as canton from resolved""",
    *_RESOLVE_IN,
)
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a log, hits with their place or municipality, misses without."""
    place = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Place "), F.col("event_id").cast("string")))
    return _resolved(spark, sf_dir).select("event_id", labels.log_label(F.col("outcome") == "hit", place, "municipality", "canton").alias("l")).select("event_id", "l.*")


@query("select event_type as name, count(*) as n from f_hits where hit_id % 2 = 0 group by 1", "f_hits")
def layer_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of two sites, one of which has the layer switched off."""
    rows = adapter(spark, sf_dir, "f_hits")
    sites = [H.enabled_only(rows.filter(F.col("hit_id") % 2 == k), on) for k, on in ((0, True), (1, False))]
    return sites[0].unionByName(sites[1]).groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))


_ART = "case when outcome = 'hit' then 'preich' else 'dernaebe' end"
_REASON = "case outcome when 'abroad' then 'usland' when 'border_water' then 'grenzwasser' end"


@query(
    f"""with {S.RESOLVED} select event_id, 'throw_resolved_server' as name, {_ART} as art, event_id * 37 % 900 + 12 as upstream_ms, canton as kanton, water as wasser, case when outcome = 'hit' then cast(floor(km + 0.5) as bigint) end as distanz_km,
 case when outcome = 'hit' then direction end as richtig, elevation as hoechi, {_REASON} as grund, 0 as problems from resolved""",
    *_RESOLVE_IN,
)
def resolved_server_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server events of resolved throws, held against their contract and their JSON params read back."""
    rows = _resolved(spark, sf_dir).withColumn("upstream_ms", F.col("event_id") * 37 % 900 + 11.75)
    e = points.resolved_server_events(rows)
    p = F.from_json("params", "art string, upstream_ms long, kanton string, wasser boolean, distanz_km long, richtig string, hoechi int, grund string")
    return e.select("event_id", "name", p.alias("p"), F.size(H.contract_problems(F.col("name"), F.col("params"))).alias("problems")).select("event_id", "name", "p.*", "problems")


@query(
    f"""with {S.RESOLVED} select event_id, {_ART} as outcome, case event_id % 3 when 0 then 'sufer' when 1 then 'gschlämpert' else 'chnorz' end as throw_quality, canton, municipality, elevation,
 round(case when outcome = 'hit' then km end, 6) as distance_km, case when outcome = 'hit' then direction end as bearing, water, {_REASON} as miss_reason, 0 as problems from resolved""",
    *_RESOLVE_IN,
)
def completed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client events of completed throws, held against their contract and their JSON params read back."""
    third = F.col("event_id") % 3
    style = labels.throw_style(third == 2, third.cast("double"), F.lit(0.5))
    e = points.completed_events(_resolved(spark, sf_dir).withColumn("throw_style", style))
    p = F.from_json("params", "outcome string, throw_quality string, canton string, municipality string, elevation int, distance_km double, bearing string, water boolean, miss_reason string")
    rows = e.select("event_id", p.alias("p"), F.size(H.contract_problems(F.col("name"), F.col("params"))).alias("problems")).select("event_id", "p.*", "problems")
    return rows.withColumn("distance_km", r6("distance_km"))


@query(
    f"""with pairs as (select a.place_id, b.place_id as nearest_id, {S.km('a.lat', 'a.lon', 'b.lat', 'b.lon')} as km from f_places a join f_places b on a.place_id <> b.place_id),
best as (select * from pairs where km <= 20 qualify row_number() over (partition by place_id order by km, nearest_id) = 1)
select p.place_id, b.nearest_id, round(b.km, 6) as km from f_places p left join best b using (place_id)""",
    "f_places",
)
def place_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place's nearest neighbour within 20 km; the most isolated have none."""
    return nearest.place_isolation(adapter(spark, sf_dir, "f_places"), 20.0).select("place_id", "nearest_id", r6("km", "km"))


# ---- logs -------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "f_log").withColumn("canton", F.col("canton_id").cast("string"))


@query(f"with {S.LOG} select user_key, event_id, place, is_hit, canton from latest", "f_log")
def latest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 entries of each user since the last clear."""
    return L.latest_log(_log(spark, sf_dir)).select("user_key", "event_id", "place", "is_hit", "canton")


_MILESTONES = """fresh as (select e.*, (select count(distinct x.canton) from entries x where x.user_key = e.user_key and x.epoch = e.epoch and x.is_hit and x.rn between e.rn - 200 and e.rn - 1) + 1 as collected
  from entries e where is_hit and canton is not null and not exists (select 1 from entries x where x.user_key = e.user_key and x.epoch = e.epoch and x.canton = e.canton and x.rn between e.rn - 200 and e.rn - 1))"""


@query(f"with {S.LOG}, {_MILESTONES} select user_key, event_id, canton, collected, least(rn, 201) as log_size from fresh", "f_log")
def canton_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cantons that come into the log of 200, again where they had dropped out."""
    return L.canton_milestones(_log(spark, sf_dir)).select("user_key", "event_id", "canton", F.col("collected").cast("long").alias("collected"), F.col("log_size").cast("long").alias("log_size"))


@query(f"with {S.LOG}, {_MILESTONES} select user_key, event_id, least(rn, 201) as throw_count from fresh where collected = 25", "f_log")
def full_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments at which a collection of 25 became complete."""
    return L.all_cantons_milestones(_log(spark, sf_dir), 25).select("user_key", "event_id", F.col("throw_count").cast("long").alias("throw_count"))


_SKIN_SQL = "select user_key, event_id, skin, threshold from entries join (values ('zahnstoecher', 5), ('chaesmaesser', 15), ('alphorn', 30)) s(skin, threshold) on rn = threshold"


@query(f"with {S.LOG} {_SKIN_SQL}", "f_log")
def skin_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that unlock a skin."""
    return L.skin_milestones(_log(spark, sf_dir)).select("user_key", "event_id", "skin", "threshold")


@query(f"with {S.LOG} select user_key, array_to_string(list_sort(list(distinct canton) filter (where is_hit and canton is not null)), ',') as cantons, count(distinct case when is_hit then canton end) as n_cantons from latest group by user_key", "f_log")
def collected_cantons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct cantons in each user's present log."""
    names = F.when(F.col("n_cantons") > 0, F.array_join("cantons", ","))  # as in SQL, none where a log has only misses
    return L.collected_cantons(_log(spark, sf_dir)).select("user_key", names.alias("cantons"), "n_cantons")


def _closed(rows: str, key: str, slot: int = 1_000) -> str:
    """SQL: the rows whose slot of event time a watermark of three days has passed."""
    return f"closed as (select {key} from {rows} where epoch_ms(ts) // {slot} * {slot} + {slot} <= (select epoch_ms(max(ts)) - 259200000 from {rows}))"


_PROPS = "props as (select u.user_key, coalesce(n, 0) as throw_count, coalesce(c, 0) as cantons_collected, 1 + (coalesce(n, 0) >= 5)::int + (coalesce(n, 0) >= 15)::int + (coalesce(n, 0) >= 30)::int as dart_skins_unlocked from (select distinct user_key from log) u left join (select user_key, count(*) as n, count(distinct case when is_hit then canton end) as c from latest group by user_key) l using (user_key))"


@query(f"with {S.LOG}, {_PROPS} select * from props", "f_log")
def user_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each user's present log."""
    return L.user_properties(_log(spark, sf_dir))


_OVER_TIME_SQL = (
    f"""with {S.LOG}, {_closed("log", "event_id")}, over_time as (select e.user_key, e.event_id, case when is_clear then 0 else (select count(*) from entries x where x.user_key = e.user_key and x.epoch = e.epoch and (x.ts, x.event_id) <= (e.ts, e.event_id)) end as n,
 e.epoch, e.ts, e.is_clear from epochs e)
select o.user_key, o.event_id, least(n, 200) as throw_count, case when o.is_clear then 0 else (select count(distinct x.canton) from entries x where x.user_key = o.user_key and x.epoch = o.epoch and x.is_hit and x.rn between o.n - 199 and o.n) end as cantons_collected,
 1 + (n >= 5)::int + (n >= 15)::int + (n >= 30)::int as dart_skins_unlocked from over_time o"""
)


@query(_OVER_TIME_SQL, "f_log")
def user_properties_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties after every change of the log."""
    return L.user_properties_over_time(_log(spark, sf_dir)).drop("ts")


@query(
    f"""with {S.LOG}, cantons as (select cast(n_nationkey as varchar) as canton from nation), have as (select distinct user_key, canton from latest where is_hit),
card as (select u.user_key, c.canton, h.canton is not null as collected from (select distinct user_key from log) u cross join cantons c left join have h on h.user_key = u.user_key and h.canton = c.canton)
select *, sum(collected::int) over (partition by user_key)::bigint as n_collected, sum(collected::int) over (partition by user_key) = (select count(*) from cantons) as complete from card""",
    "f_log",
)
def stamp_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user with every canton: collected or not."""
    cantons = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("canton"))
    return L.stamp_card(_log(spark, sf_dir), cantons)


@query(
    """with c as (select event_id, cast(floor(user_id / 5) as bigint) as user_key, ts, case event_id % 4 when 0 then 'view' when 1 then 'throw_style' when 2 then 'sound' else 'other' end as key, event_type as value from events)
select user_key, event_id, coalesce(last_value(case when key = 'view' then value end ignore nulls) over w, 'charte') as view, coalesce(last_value(case when key = 'throw_style' then value end ignore nulls) over w, 'zieh') as throw_style,
 coalesce(last_value(case when key = 'sound' then value end ignore nulls) over w, 'false') as sound, 'pfyl' as dart_skin from c window w as (partition by user_key order by ts, event_id rows between unbounded preceding and current row)"""
)
def settings_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All settings after each change."""
    key = F.when(F.col("event_id") % 4 == 0, "view").when(F.col("event_id") % 4 == 1, "throw_style").when(F.col("event_id") % 4 == 2, "sound").otherwise("other")
    changes = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.floor(F.col("user_id") / 5).alias("user_key"), "ts", key.alias("key"), F.col("event_type").alias("value"))
    return L.settings_as_of(changes).drop("ts")


@query(
    "select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
)
def first_engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and kind."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    return L.first_engagement(rows, "user_id", "event_type").drop("ts")


# ---- hits -------------------------------------------------------------------------------------

_CONSENT = """choices as (select *, url_decode(nullif(regexp_extract(cookie, '(?:^|; )ow_consent=([^;]*)', 1), '')) as choice from f_hits),
consent as (select * exclude (choice), case when gpc then 'denied' when choice is null or not json_valid(choice) then 'granted' else json_extract_string(choice, '$.analytics_storage') end as analytics_storage,
 case when gpc then 'denied' when choice is null or not json_valid(choice) then 'denied' else json_extract_string(choice, '$.ad_storage') end as ad_storage from choices)"""


@query(f"with {_CONSENT} select hit_id, analytics_storage, ad_storage from consent", "f_hits")
def hit_consent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consent per hit: privacy signal, cookie, defaults."""
    return H.resolve_consent(adapter(spark, sf_dir, "f_hits")).select("hit_id", "analytics_storage", "ad_storage")


_INTERNAL = "flags as (select *, coalesce(last_value(case when query in ('ow_internal=1', 'ow_internal=0') then query end ignore nulls) over (partition by user_id order by ts, hit_id rows between unbounded preceding and 1 preceding) = 'ow_internal=1', false) as internal from f_hits)"


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.regexp_extract("query", r"(?:^|&)ow_internal=([^&]*)", 1)
    return L.internal_flag(adapter(spark, sf_dir, "f_hits").withColumn("internal_value", value))


@query(f"with {_INTERNAL} select hit_id, internal, case when internal then 'internal' end as traffic_type from flags", "f_hits")
def internal_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device flag before each hit."""
    return H.tag_internal(_flagged(spark, sf_dir)).select("hit_id", "internal", "traffic_type")


def _cookie(name: str) -> str:
    """SQL: the last value of a cookie of that name; parts end at semicolons and have an equals sign."""
    return f"[trim(x[instr(x, '=') + 1:]) for x in string_split(coalesce(cookie, ''), ';') if instr(x, '=') > 0 and trim(x[:instr(x, '=') - 1]) = '{name}'][-1]"


_FOUND = f"nullif(regexp_extract({_cookie('_ga')}, '^GA[0-9]+[.][0-9]+[.]([0-9]+[.][0-9]+)$', 1), '')"
_SESSION = f"nullif(regexp_extract({_cookie('_ga_S')}, '^GS[0-9]+[.][0-9]+[.]s?([0-9]+)', 1), '')"
_CLIENT = f"coalesce({_FOUND}, sha256(cast(hit_id as varchar)))"
_SOURCE = f"case when {_FOUND} is null then 'synthetic' else 'cookie' end"
_DROPPED = "length(event_type) > 40 or coalesce(len(json_keys(case when json_valid(props) then props end)), 0) > 25"


@query(f"select hit_id, {_CLIENT} as client_id, {_SOURCE} as client_source, {_SESSION} as session_id from f_hits", "f_hits")
def hit_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client and session ids from cookies, synthetic where there is none."""
    return H.derive_client(adapter(spark, sf_dir, "f_hits"), deterministic=True).select("hit_id", "client_id", "client_source", "session_id")


@query(
    f"""select hit_id, '{{"client_id":"' || {_CLIENT} || '","events":[{{"name":"' || event_type || '","params":{{"value":' || cast(user_id as varchar) || ',"even":' || case when user_id % 2 = 0 then 'true' else 'false' end || ',"kind":"' || event_type || '","engagement_time_msec":1,"client_source":"' ||
 {_SOURCE} || '"' || coalesce(',"session_id":"' || {_SESSION} || '"', '') || '}}}}]}}' as payload from f_hits""",
    "f_hits",
)
def server_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads for the measurement endpoint."""
    rows = H.derive_client(adapter(spark, sf_dir, "f_hits"), deterministic=True).withColumn("params", F.struct(F.col("user_id").alias("value"), (F.col("user_id") % 2 == 0).alias("even"), F.col("event_type").alias("kind"), F.lit(None).cast("int").alias("absent")))
    return H.server_payload(rows, "event_type").select("hit_id", "payload")


@query(
    """select hit_id, length(name) > 40 or n > 25 as will_be_dropped from (select hit_id, case when hit_id % 9 = 0 then repeat('n', cast(38 + hit_id % 5 as int)) else event_type end as name, hit_id % 30 as n from f_hits)""",
    "f_hits",
)
def dropped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events beyond the collector's limits."""
    name = F.when(F.col("hit_id") % 9 == 0, F.repeat(F.lit("n"), (38 + F.col("hit_id") % 5).cast("int"))).otherwise(F.col("event_type"))
    keys = F.expr("transform(sequence(0, cast(hit_id % 30 as int)), i -> concat('k', i))")
    params = F.to_json(F.map_from_arrays(F.slice(keys, 1, (F.col("hit_id") % 30).cast("int")), F.slice(keys, 1, (F.col("hit_id") % 30).cast("int"))))
    return H.tag_dropped(adapter(spark, sf_dir, "f_hits").withColumns({"name": name, "params": params})).select("hit_id", "will_be_dropped")


@query(
    f"with {_CONSENT}, {_INTERNAL} select c.event_type as name, count(*) as n, count(distinct c.user_id) as users from consent c join flags f using (hit_id) where analytics_storage = 'granted' and not internal group by 1",
    "f_hits",
)
def hit_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From hit to report: consent, internal tag, external traffic by event."""
    rows = H.tag_internal(H.enabled_only(H.consented_only(H.resolve_consent(_flagged(spark, sf_dir)))))
    return reports.traffic_report(reports.external_only(rows).withColumn("name", F.col("event_type")), F.lit("all")).drop("dimension")


@query(
    r"""with cut as (select *, case href when 'https://münchen.example/x' then 'xn--mnchen-3ya.example' when 'https://exa%6Dple.com/' then 'example.com' when 'http://0x7f.1/' then '127.0.0.1' when 'http://192.168.257/' then '192.168.1.1' when 'https://BÜCHER%2Eexample:8443/' then 'xn--bcher-kva.example' end as known,
  regexp_extract(lower(trim(href)), '^([a-z][a-z0-9+.-]*):', 1) as scheme, regexp_extract(lower(trim(href)), '^[a-z][a-z0-9+.-]*:/*([^/?#]*)', 1) as place from f_clicks),
hosts as (select *, coalesce(known, regexp_extract(regexp_replace(place, '^.*@', ''), '^[^:]*', 0)) as host, try_cast(regexp_extract(place, ':([0-9]+)$', 1) as int) as port from cut),
parsed as (select *, scheme in ('http', 'https', 'ftp') and host <> '' and host <> '256.1.1.1' and not regexp_matches(host, '[ %|<>^]') and coalesce(port, 0) <= 65535 as good,
 host || case when port is null or (scheme = 'https' and port = 443) or (scheme = 'http' and port = 80) then '' else ':' || port end as whole from hosts),
judged as (select *, coalesce(good and scheme <> 'ftp' and whole <> 'site.example.com', false) as outbound from parsed)
select page_id, href, case when good then host else '' end as link_domain, outbound,
 case when page_id % 6 = 0 then 'nav_click' when page_id % 10 = 1 then 'citation_click' when href like 'http%' then 'outbound_click' else 'internal_link_click' end as event,
 page_id % 3 > 0 and page_id % 5 > 0 and outbound as unhandled,
 case when page_id % 4 = 0 then 2 else 1 end as n_project_events, case when page_id % 2 = 0 then '/p' || page_id || '?q=1' else '/p' || page_id end as page_path from judged""",
    "f_clicks",
)
def link_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by domain, outbound or not, event names, and page paths."""
    c = adapter(spark, sf_dir, "f_clicks")
    location, kind = F.when(F.col("page_id") % 6 == 0, "header"), F.when((F.col("page_id") % 10 == 1) & (F.col("page_id") % 6 != 0), "citation")
    host = F.lit("site.example.com")
    return c.select(
        "page_id", "href", text.link_fields("href", F.lit(" x "))["link_domain"].alias("link_domain"), text.is_outbound("href", host).alias("outbound"), text.classify_click("href", location, kind).alias("event"),
        text.unhandled_outbound(F.col("page_id") % 3 > 0, F.col("page_id") % 5 == 0, "href", host).alias("unhandled"),
        F.size(text.project_click_events(F.when(F.col("page_id") % 4 == 0, "Download").otherwise("Demo"))).alias("n_project_events"),
        text.page_path(F.concat(F.lit("/p"), F.col("page_id").cast("string")), F.when(F.col("page_id") % 2 == 0, "q=1").otherwise("")).alias("page_path"),
    )


@query(
    """select name, layer, count(*) as n from (select event_type as name, 'client' as layer from f_hits where hit_id % 3 > 0 union all select event_type || '_server', 'server' from f_hits where hit_id % 3 = 0) group by all""",
    "f_hits",
)
def layers_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client and server hits under one schema, counted."""
    h = adapter(spark, sf_dir, "f_hits")
    client = h.filter("hit_id % 3 > 0").select(F.col("event_type").alias("name"), "hit_id", "query")
    server = h.filter("hit_id % 3 = 0").select(F.concat("event_type", F.lit("_server")).alias("name"), "hit_id")
    return H.all_hits(client, server).groupBy("name", "layer").agg(F.count("*").alias("n"))


@query(
    """select event_id, case when event_id % 13 = 0 then 'no_move' when sqrt(dx * dx + dy * dy) < 10 then 'throw_abandoned' else 'throw_input_method' end as outcome, round(100 + dx * (case when event_id % 2 = 0 then -2.7 else 2.7 end), 6) as target_x,
 round(least(sqrt(dx * dx + dy * dy) / 210, 1), 6) as force, round(greatest(6, 400 * 0.38 * (0.4 + 0.6 * least(sqrt(dx * dx + dy * dy) / 210, 1))), 6) as sigma,
 case when shank then 'shank' when sqrt(dx * dx + dy * dy) > 106 * 1.15 then 'sloppy' else 'clean' end as style from f_throws""",
    "f_throws",
)
def drags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aim, force, scatter, style and event of drags."""
    t = adapter(spark, sf_dir, "f_throws")
    still = F.col("event_id") % 13 == 0
    f = labels.drag_features(F.lit(100.0), F.lit(100.0), "dx", "dy", F.when(F.col("event_id") % 2 == 0, "back").otherwise("along"))
    return t.select(
        "event_id", labels.drag_outcome(F.when(~still, F.col("dx")), "dy").alias("outcome"), r6(f["target_x"], "target_x"), r6(f["force"], "force"), r6(labels.scatter_sigma(F.lit(400.0), f["force"]), "sigma"),
        labels.throw_style("shank", labels.drag_length("dx", "dy"), F.lit(106)).alias("style"),
    )


# ---- reports ----------------------------------------------------------------------------------


def _throws(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapter(spark, sf_dir, "f_throws")
    d = F.hypot("dx", "dy")
    return t.withColumns({"deviation_px": d, "km": d * 0.29, "inside": F.col("dx") > 0, "near": F.col("event_id") % 5 == 0})


_DEV = "sqrt(dx * dx + dy * dy)"


@query(f"select force, count(*) as throws, round(quantile_cont({_DEV} * 0.29, 0.5), 6) as median_km, round(avg(({_DEV} > 400)::int), 6) as off_share from f_throws group by force", "f_throws")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median miss and share off the board per force."""
    r = reports.calibration_report(_throws(spark, sf_dir), 400.0)
    return r.select("force", "throws", r6("median_km", "median_km"), r6("off_share", "off_share"))


@query(f"select force, round(list_sort(list({_DEV} * 0.29))[cast(floor(count(*) / 2) as int) + 1], 6) as median_km from f_throws group by force", "f_throws")
def calibration_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the upper middle value."""
    return reports.calibration_report(_throws(spark, sf_dir), 400.0, "upper").select("force", r6("median_km", "median_km"))


@query(f"select force, round(avg(shank::int), 6) as shank_share, round(sqrt(avg({_DEV} * {_DEV})), 6) as rms_px, round(avg((dx > 0)::int), 6) as inside_share, round(avg((event_id % 5 = 0)::int), 6) as near_share from f_throws group by force", "f_throws")
def throw_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shanks, scatter and shares per force."""
    r = reports.throw_quality_report(_throws(spark, sf_dir))
    return r.select("force", *[r6(c, c) for c in ("shank_share", "rms_px", "inside_share", "near_share")])


@query(
    """with staged as (select *, coalesce(last_value(input_method ignore nulls) over (partition by session_id order by ts, hit_id rows between unbounded preceding and current row), 'none') as method from f_funnel where name like 'throw_%'),
reached as (select method, session_id, max((name = 'throw_started')::int) as a, max((name = 'throw_abandoned')::int) as b, max((name = 'throw_input_method')::int) as c, max((name = 'throw_completed')::int) as d, max((name = 'throw_off_map')::int) as e, max((name = 'throw_api_error')::int) as f from staged group by all)
select method, count(*) as sessions, sum(a)::bigint as throw_started, sum(b)::bigint as throw_abandoned, sum(c)::bigint as throw_input_method, sum(d)::bigint as throw_completed, sum(e)::bigint as throw_off_map, sum(f)::bigint as throw_api_error from reached group by method""",
    "f_funnel",
)
def throw_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that reach each stage, by input method."""
    return reports.throw_funnel(adapter(spark, sf_dir, "f_funnel"))


@query("select share_method, outcome, count(*) as n, round(count(*) / (select count(*) from f_funnel where name = 'share_attempt'), 6) as share from f_funnel where name = 'share_result' group by all", "f_funnel")
def share_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of shares by method."""
    r = reports.share_report(adapter(spark, sf_dir, "f_funnel"))
    return r.select("share_method", "outcome", "n", r6("share", "share"))


@query("select event_type as outcome, count(*) as n, round(avg(value), 6) as mean_ms, round(quantile_cont(value, 0.95), 6) as p95_ms, count(*) filter (where event_type = 'error') as errors, round(count(*) / (select count(*) from events), 6) as share from events group by event_type")
def upstream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency of lookups by outcome."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("outcome"), F.col("value").alias("upstream_ms"))
    r = reports.upstream_report(rows)
    return r.select("outcome", "n", r6("mean_ms", "mean_ms"), r6("p95_ms", "p95_ms"), "errors", r6("share", "share"))


@query(f"with {S.RESOLVED} select outcome as miss_reason, count(*) as n, round(count(*) / (select count(*) from resolved), 6) as share from resolved where outcome <> 'hit' group by outcome", *_RESOLVE_IN)
def miss_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why lookups missed, as shares of all."""
    miss = F.col("outcome") != "hit"
    rows = _resolved(spark, sf_dir).select(F.when(miss, "miss").otherwise("hit").alias("outcome"), F.when(miss, F.col("outcome")).alias("miss_reason"))
    return reports.miss_report(rows).select("miss_reason", "n", r6("share", "share"))


@query(f"select {_SOURCE} as client_source, count(*) as n, count(*) filter (where hit_id % 4 = 0) as with_throw, count(*) filter (where hit_id % 8 = 0) as resolved from f_hits group by 1", "f_hits")
def unfurls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link previews by client source."""
    rows = H.derive_client(adapter(spark, sf_dir, "f_hits"), deterministic=True).withColumns({"has_throw": F.col("hit_id") % 4 == 0, "resolved": F.col("hit_id") % 8 == 0})
    return reports.unfurl_report(rows)


@query(
    """select '/p' || cast(event_id % 6 as varchar) as page_path, case event_id % 3 when 0 then 'CLS' when 1 then 'LCP' else 'INP' end as metric, event_type as rating, count(*) as n,
 round(quantile_cont(cast(floor((case when event_id % 3 = 0 then value * 1000 else value end) + 0.5) as bigint)::double, 0.75), 6) as p75 from events where value is not null group by 1, 2, 3"""
)
def web_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled web vitals by page, metric and rating."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value is not null")
    metric = F.when(F.col("event_id") % 3 == 0, "CLS").when(F.col("event_id") % 3 == 1, "LCP").otherwise("INP")
    rows = e.select(F.concat(F.lit("/p"), (F.col("event_id") % 6).cast("string")).alias("page_path"), metric.alias("metric"), F.col("event_type").alias("rating"), labels.scale_vital(metric, "value").alias("value"))
    r = reports.vitals_report(rows)
    return r.select("page_path", "metric", "rating", "n", r6("p75", "p75"))


@query(f"with {S.LOG}, {_PROPS} select e.event_type as name, p.dart_skins_unlocked, count(*) as n from events e left join props p on p.user_key = cast(floor(e.user_id / 5) as bigint) group by all", "f_log")
def events_by_skins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events split by a user property."""
    props = L.user_properties(_log(spark, sf_dir))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("name"), F.floor(F.col("user_id") / 5).alias("user"))
    return reports.segment_by(e, props, "user", "dart_skins_unlocked")


@query("select name, input_method as detail, count(*) as n, count(distinct user_id) as users from f_funnel where name in ('throw_started', 'throw_input_method') group by all", "f_funnel")
def feature_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use of input methods."""
    return reports.feature_report(adapter(spark, sf_dir, "f_funnel"), ("throw_started", "throw_input_method"), "input_method")


@query(
    f"""with {S.LOG}, {_MILESTONES}, worn as (select distinct user_key, skin from ({_SKIN_SQL})), best as (select user_key, max(collected) as m from fresh group by user_key)
select 'cantons' as kind, cast(m as varchar) as level, count(*) as users from best group by m union all select 'skin', skin, count(*) from worn group by skin
union all select 'complete', 'all', count(distinct user_key) from fresh where collected = 25 having count(*) > 0""",
    "f_log",
)
def collection_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by cantons, skins and full collections reached."""
    log = _log(spark, sf_dir)
    return reports.collection_report(L.canton_milestones(log), L.skin_milestones(log), L.all_cantons_milestones(log, 25))


# ---- quality ----------------------------------------------------------------------------------

_CATALOG = f"""catalog as (select name, lat, lon, 'K' || cast(canton_id as varchar) as canton, case place_id % 3 when 0 then 'town' when 1 then 'village' else 'peak' end as kind, place_id from f_places where place_id % 10 <> 9),
lookups as (select name, case when place_id % 13 = 0 then 'error' when place_id % 11 = 0 then 'border_water' else 'hit' end as outcome, case when place_id % 8 = 0 then 'XX' else 'K' || cast(canton_id as varchar) end as r_canton,
 case when place_id % 17 = 0 then null else cast(place_id * 5 as int) end as elevation, place_id % 6 = 0 as water from f_places),
saved as (select name, cast(place_id * 5 + (case when place_id % 7 = 0 then 26 else 25 end) as int) as metres from f_places where place_id % 19 <> 0),
verified as (select coalesce(c.name, s.name) as name, case when c.name is null then 'stale' when not {S.in_box('c.lat', 'c.lon')} then 'outside' when l.outcome = 'error' then 'error' when l.outcome <> 'hit' then 'miss' when l.elevation is null then 'no_elevation'
 when s.name is null then 'new' when abs(l.elevation - s.metres) > 25 then 'drift' else 'ok' end as status, c.canton, l.r_canton, c.kind, l.water from catalog c left join lookups l using (name) full outer join saved s on s.name = c.name),
noted as (select name, status, case when status = 'ok' then nullif(concat_ws(',', case when not contains(coalesce(r_canton, ''), canton) then 'canton' end, case when kind in ('town', 'village') and water then 'in_water' end), '') end as note from verified)"""


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapter(spark, sf_dir, "f_places")
    n = F.col("place_id")
    canton = F.concat(F.lit("K"), F.col("canton_id").cast("string"))
    catalog = p.filter(n % 10 != 9).select("name", "lat", "lon", canton.alias("canton"), F.when(n % 3 == 0, "town").when(n % 3 == 1, "village").otherwise("peak").alias("kind"))
    looked = p.select("name", F.when(n % 13 == 0, "error").when(n % 11 == 0, "border_water").otherwise("hit").alias("outcome"), F.when(n % 8 == 0, "XX").otherwise(canton).alias("canton"), F.when(n % 17 != 0, (n * 5).cast("int")).alias("elevation"), (n % 6 == 0).alias("water"))
    saved = p.filter(n % 19 != 0).select("name", (n * 5 + F.when(n % 7 == 0, 26).otherwise(25)).cast("int").alias("metres"))
    return quality.verify_catalog(catalog, looked, saved)


@query(f"with {_CATALOG} select name, status, note from noted", "f_places")
def catalog_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog against lookups and snapshot."""
    return _verified(spark, sf_dir)


@query(f"with {_CATALOG} select count(*) filter (where status <> 'stale') as catalog, count(*) filter (where status <> 'ok') as failed, count(*) filter (where status <> 'stale') - count(*) filter (where status <> 'ok') as passed, count(*) filter (where note is not null) as to_look_at from noted", "f_places")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the catalog check."""
    return quality.verification_summary(_verified(spark, sf_dir))


@query("select page_id, len(regexp_extract_all(html, '<p>'))::int as n, len(regexp_extract_all(html, '<p>')) = 0 as missing from pages")
def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern hits per page, pages without one marked."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("word"), "page_id", text.page_pattern_hits("html", "<p>").alias("n"))
    gone = quality.missing_words(p.select("word"), p.select("word", "n")).withColumn("missing", F.lit(True))
    return p.join(gone, "word", "left").select("page_id", "n", F.coalesce("missing", F.lit(False)).alias("missing"))


@query("select count(*) filter (where page_id % 20 = 0 or len(regexp_extract_all(html, 'href')) > 0) as found, count(*) as total from pages")
def vocabulary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words found, where failed pages count as found."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.when(F.col("page_id") % 20 != 0, text.page_pattern_hits("html", "href")).alias("n"))
    return quality.vocab_summary(p)


# ---- telemetry --------------------------------------------------------------------------------


@query(
    """select event_id, round(case when rn = 1 then 0 when ticks >= b and s > 0 then (ticks - b) / s end, 6) as rate from (select *, row_number() over w as rn, lag(ticks) over w as b, epoch_us(ts)::double / 1e6 - epoch_us(lag(ts) over w)::double / 1e6 as s from f_counter window w as (partition by host order by ts, event_id))""",
    "f_counter",
)
def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates from cumulative counters with resets."""
    return telemetry.counter_rate(adapter(spark, sf_dir, "f_counter")).select("event_id", r6("rate", "rate"))


@query(
    """select event_id, round(avg(ticks) over w, 6) as rolling_mean, max(ticks) over w as rolling_max, count(ticks) over w as rolling_n, round(last_value(slow_value ignore nulls) over (partition by host order by ts, event_id rows between unbounded preceding and current row), 6) as filled
from f_counter window w as (partition by host order by ts, event_id rows between 119 preceding and current row)""",
    "f_counter",
)
def rolling_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling 120 samples and the last known slow metric."""
    r = telemetry.forward_fill(telemetry.rolling_samples(adapter(spark, sf_dir, "f_counter"), "ticks"), "slow_value")
    return r.select("event_id", r6("rolling_mean", "rolling_mean"), "rolling_max", "rolling_n", r6("filled", "filled"))


_RATES = """rates as (select event_id, n, round(case when n >= 2 and t > f then n / ((t - f) / 1e6) * 60 / 5 end, 6) as rate from (select event_id, epoch_us(ts) as t, count(*) over w as n, min(epoch_us(ts)) over w as f from f_moves window w as (partition by device order by epoch_us(ts) range between 3600000000 preceding and current row)))"""


@query(f"with {_RATES} select * from rates", "f_moves")
def rolling_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a minute over the last hour."""
    return telemetry.rolling_rate(adapter(spark, sf_dir, "f_moves"), "device", 3600).select("event_id", "n", r6("rate", "rate"))


_PATH = "path as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as distance, (epoch_us(ts) - epoch_us(lag(ts) over w)) / 1e6 as dt from f_moves window w as (partition by device order by ts, event_id))"


@query(f"with {_PATH} select event_id, round(distance, 6) as distance, round(case when dt > 0 and dt < 1 then distance / dt end, 6) as speed, round(distance / 4330.7, 6) as metres from path", "f_moves")
def cursor_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and speed between cursor positions."""
    r = telemetry.path_length(adapter(spark, sf_dir, "f_moves"), "device")
    return r.select("event_id", r6("distance", "distance"), r6("speed", "speed"), r6(labels.points_to_metres("distance", F.lit(0.0), F.lit(None).cast("double")), "metres"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.daily_summary(telemetry.path_length(adapter(spark, sf_dir, "f_moves"), "device"))


_DAYS = f"""{_PATH}, days as (select cast(ts as date) as date, count(*) filter (where kind = 'key') as keys, count(*) filter (where kind = 'left_click') as left_clicks, count(*) filter (where kind = 'right_click') as right_clicks, count(*) filter (where kind = 'other_click') as other_clicks,
 coalesce(sum(abs(dx)) filter (where kind = 'scroll'), 0) as scroll_x, coalesce(sum(abs(dy)) filter (where kind = 'scroll'), 0) as scroll_y, coalesce(sum(distance), 0) as distance, min(ts) as first_ts, max(ts) as last_ts, count(distinct date_trunc('minute', ts)) as active_minutes,
 max(case when dt > 0 and dt < 1 then distance / dt end) as top_speed from path group by 1)"""


@query(f"with {_DAYS} select cast(date as varchar) as date, keys, left_clicks, right_clicks, other_clicks, round(scroll_x, 4) as scroll_x, round(scroll_y, 4) as scroll_y, round(distance, 4) as distance, epoch_us(first_ts) as first_us, epoch_us(last_ts) as last_us, active_minutes from days", "f_moves")
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity per day."""
    d = _days(spark, sf_dir)
    return d.select(F.col("date").cast("string").alias("date"), "keys", "left_clicks", "right_clicks", "other_clicks", *[F.round(c, 4).alias(c) for c in ("scroll_x", "scroll_y", "distance")], telemetry.micros("first_ts").alias("first_us"), telemetry.micros("last_ts").alias("last_us"), "active_minutes")


@query(f"with {_DAYS} select sum(keys)::bigint as keys, sum(left_clicks + right_clicks + other_clicks)::bigint as clicks, round(sum(distance), 3) as distance, count(*) as days from days", "f_moves")
def all_time_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all days."""
    return telemetry.all_time_totals(_days(spark, sf_dir)).withColumn("distance", F.round("distance", 3))


@query(f"with {_DAYS} select count(*) filter (where active_minutes > 200) as days, round(avg((active_minutes > 200)::int), 6) as share from days", "f_moves")
def outlier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, and their share, above a limit."""
    return telemetry.outlier_days(_days(spark, sf_dir), "active_minutes", 200.0).select("days", r6("share", "share"))


@query("select cast(cast(ts as date) as varchar) as date, cast(extract(hour from ts) as int) as hour, count(*) filter (where kind = 'key') as keys, count(*) filter (where kind like '%click') as clicks from f_moves group by 1, 2", "f_moves")
def hourly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and clicks per hour."""
    return telemetry.hourly_summary(adapter(spark, sf_dir, "f_moves")).withColumn("date", F.col("date").cast("string"))


@query("select cast(cast(ts as date) as varchar) as date, bundle_id, count(*) filter (where kind = 'key') as keys, count(*) filter (where kind like '%click') as clicks from f_moves group by 1, 2", "f_moves")
def app_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and clicks per application."""
    return telemetry.app_usage(adapter(spark, sf_dir, "f_moves")).withColumn("date", F.col("date").cast("string"))


@query(
    "select cast(cast(ts as date) as varchar) as date, user_id % 2 as screen_id, cast(least(49, greatest(0, floor(x / 2560.0 * 50))) as int) as bucket_x, cast(least(49, greatest(0, floor(y / 1440.0 * 50))) as int) as bucket_y, count(*) as n from f_moves group by all",
    "f_moves",
)
def mouse_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions per day, screen and cell."""
    m = adapter(spark, sf_dir, "f_moves").withColumns({"screen_id": F.col("user_id") % 2, "bucket_x": geo.heatmap_bucket("x", 2560.0), "bucket_y": geo.heatmap_bucket("y", 1440.0)})
    return telemetry.mouse_heatmap(m).withColumn("date", F.col("date").cast("string"))


@query("select cast(cast(ts as date) as varchar) as date, key_code, flags & 1966080 as modifier_flags, count(*) as n from f_moves where kind = 'key' group by all", "f_moves")
def keyboard_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys per day, position and modifiers."""
    k = adapter(spark, sf_dir, "f_moves").filter("kind = 'key'").withColumn("modifier_flags", labels.masked_modifiers("flags"))
    return telemetry.keyboard_heatmap(k).withColumn("date", F.col("date").cast("string"))


@query(
    "select user_id % 20 as k, count(*) as n, epoch_us(min(ts)) as first_us, round(arg_max(value, event_id), 6) as mean, round(max(value), 6) as peak, max(event_id) as seq from events where value is not null group by 1",
)
def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial counters of two halves, upserted."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value is not null")
    part = lambda df: df.groupBy((F.col("user_id") % 20).alias("k")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max_by("value", "event_id").alias("mean"), F.max("value").alias("peak"), F.max("event_id").alias("seq"))
    m = telemetry.merge_counters(part(e.filter("event_id % 2 = 0")), part(e.filter("event_id % 2 = 1")), ["k"])
    return m.select("k", "n", telemetry.micros("first_ts").alias("first_us"), r6("mean", "mean"), r6("peak", "peak"), "seq")


@query(
    """with r as (select cast(floor(user_id / 5) as bigint) as host, 'T' || cast(event_id % 4 as varchar) as sensor, value from events where value between 0 and 150)
select host, arg_min(sensor, (-value, sensor)) as sensor, round(max(value), 6) as value, round(avg(value), 6) as mean, round(quantile_cont(value, 0.95), 6) as p95 from r group by host"""
)
def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plausible sensors: the hottest per host, mean and percentile."""
    key = F.when(F.col("event_id") % 9 >= 0, F.concat(F.lit("T"), (F.col("event_id") % 4).cast("string")))
    r = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("user_id") / 5).alias("host"), key.alias("sensor"), "value").filter(labels.plausible_sensor("sensor", "value"))
    p95 = telemetry.peak_report(r, "value", "host").select("host", r6("p95", "p95"))
    return telemetry.hottest_sensor(r).join(p95, "host").select("host", "sensor", r6("value", "value"), r6("mean", "mean"), "p95")


@query(
    """select event_id, case when (value + 10) / 160 > 0.9 then 'critical' when (value + 10) / 160 > 0.75 then 'warning' when value is not null then 'normal' end as pressure, case when value / 160 >= 0.9 then 'red' when value / 160 >= 0.7 then 'orange' when value is not null then 'green' end as band,
 round(least(100, (case when event_id % 2 = 0 then value when value > 100 then value end) / 120 * 100), 6) as health, case event_id % 4 when 0 then 'keyboard' when 1 then 'mouse' when 2 then 'trackpad' else 'other' end as device,
 case event_id % 3 when 0 then 'CPU proximity' when 1 then 'GPU' else 'Other' end as sensor, case event_id % 2 when 0 then 'dark' else 'light' end as color_scheme, case event_id % 3 when 0 then 'fine' when 1 then 'coarse' else 'none' end as pointer_type, event_id % 5 = 0 as reduced_motion from events"""
)
def device_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pressure, usage, battery, device and sensor names, device context."""
    e, n, v = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id"), F.col("value")
    name = F.when(n % 4 == 0, "Magic Keyboard").when(n % 4 == 1, "Magic Mouse").when(n % 4 == 2, "Magic Trackpad").otherwise("Thing")
    ctx = labels.device_context(n % 2 == 0, n % 3 == 0, n % 3 == 1, n % 5 == 0)
    return e.select(
        "event_id", labels.pressure_level(v, F.lit(5.0), F.lit(5.0), F.lit(160.0)).alias("pressure"), labels.usage_band(v / 160).alias("band"), r6(labels.battery_health(F.when(n % 2 == 0, v), v, F.lit(120.0)), "health"),
        labels.device_kind(name).alias("device"), labels.sensor_label(F.when(n % 3 == 0, "TC0P").when(n % 3 == 1, "TG9x").otherwise("Tz")).alias("sensor"), ctx["color_scheme"].alias("color_scheme"), ctx["pointer_type"].alias("pointer_type"), ctx["reduced_motion"].alias("reduced_motion"),
    )


@query("select user_id as source_id, count(*) filter (where kind = 'move') as mouse, count(*) filter (where kind = 'key' and hour(ts) < 4) as keys from f_moves group by 1 having count(*) filter (where kind = 'move') > 5 and count(*) filter (where kind = 'key' and hour(ts) < 4) = 0", "f_moves")
def missing_key_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with mouse events but no keys."""
    m = adapter(spark, sf_dir, "f_moves")
    counts = m.select(F.col("user_id").alias("source_id"), (F.col("kind") == "move").cast("long").alias("mouse"), ((F.col("kind") == "key") & (F.hour("ts") < 4)).cast("long").alias("keys"))
    return telemetry.missing_stream_check(counts, 5)


@query("select event_id, device, place from (select event_id, device, row_number() over (partition by device order by dx desc, event_id) as place from f_moves where dx is not null) where place <= 5", "f_moves")
def top_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five greatest values per device."""
    return telemetry.top_per_group(adapter(spark, sf_dir, "f_moves").filter("dx is not null"), F.col("dx"), 5, "device").select("event_id", "device", "place")


@query("select event_id, key_code, case when key_code < 26 then chr(97 + key_code) end as glyph from f_moves where kind = 'key'", "f_moves")
def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key positions as glyphs of a layout."""
    k = adapter(spark, sf_dir, "f_moves").filter("kind = 'key'").withColumn("layout", F.lit("plain"))
    layout = spark.range(26).select(F.lit("plain").alias("layout"), F.col("id").cast("int").alias("key_code"), F.char(F.col("id") + 97).alias("glyph"))
    return telemetry.key_glyphs(k, layout).select("event_id", "key_code", "glyph")


# ---- streams ----------------------------------------------------------------------------------


def _late(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``arrived``: up to two days after their time, so that they come out of order within and across batches."""
    delay = F.make_interval(secs=F.pmod(F.xxhash64(key), F.lit(172_800)))
    return rows.withColumn("arrived", F.col("ts").cast("timestamp") + delay)


@query(
    f"""with {S.LOG}, {_MILESTONES}, {_closed("log", "event_id")}, every as (select user_key, event_id, 'canton' as kind, canton as value, collected as count from fresh union all select user_key, event_id, 'skin', skin, threshold from ({_SKIN_SQL})
 union all select user_key, event_id, 'complete', 'all', least(rn, 201) from fresh where collected = 25) select * from every where event_id in (select event_id from closed)""",
    "f_log",
)
def stream_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milestones of a stream of throws that arrive out of order, equal to the batch ones."""
    rows = _late(_log(spark, sf_dir).drop("canton_id"), "event_id")
    return streams.run_available(rows, lambda s: ordered.milestone_stream(s, total=25, watermark="3 days"), order="arrived")


@query(f"with {_INTERNAL}, {_closed('f_hits', 'hit_id')} select user_id, hit_id, internal from flags where hit_id in (select hit_id from closed)", "f_hits")
def stream_internal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device flag held in a stream's state, hits arriving out of order."""
    value = F.regexp_extract("query", r"(?:^|&)ow_internal=([^&]*)", 1)
    rows = adapter(spark, sf_dir, "f_hits").select("hit_id", "user_id", "ts", value.alias("internal_value"))
    return streams.run_available(_late(rows, "hit_id"), lambda s: ordered.internal_flag_stream(s, watermark="3 days"), order="arrived")


@query(f"{_OVER_TIME_SQL} where o.event_id in (select event_id from closed)", "f_log")
def stream_user_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User properties after every change of a log whose rows arrive out of order."""
    rows = _late(_log(spark, sf_dir).drop("canton_id"), "event_id")
    return streams.run_available(rows, lambda s: ordered.user_properties_stream(s, watermark="3 days"), order="arrived")


@query(f"with {_closed('f_moves', 'event_id')}, {_RATES} select * from rates where event_id in (select event_id from closed)", "f_moves")
def stream_exact_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a minute over the last hour, row by row on a stream whose rows arrive out of order."""
    rows = _late(adapter(spark, sf_dir, "f_moves").select("event_id", "device", "ts"), "event_id")
    r = streams.run_available(rows, lambda s: ordered.exact_rate_stream(s, "device", 3600, watermark="3 days"), order="arrived")
    return r.select("event_id", "n", r6("rate", "rate"))


@query(f"with {_CONSENT} select hit_id, {_CLIENT} as client_id, {_DROPPED} as will_be_dropped from consent where analytics_storage = 'granted'", "f_hits")
def stream_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateless hit path on a stream, each hit once."""
    rows = adapter(spark, sf_dir, "f_hits")
    return streams.run_available(rows.union(rows), lambda s: streams.hit_stream(streams.once(s, watermark="60 days"))).select("hit_id", "client_id", "will_be_dropped")


@query(f"with {S.RESOLVED} select event_id, outcome, municipality, elevation from resolved", *_RESOLVE_IN)
def stream_resolved_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points resolved on a stream against static cell tables."""
    candidates = adapter(spark, sf_dir, "f_candidates").withColumnsRenamed({"lat": "s_lat", "lon": "s_lon"})
    heights = adapter(spark, sf_dir, "f_elevations").select(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "metres").distinct()
    return streams.run_available(adapter(spark, sf_dir, "f_points"), lambda s: streams.resolve_stream(s, candidates, heights)).select("event_id", "outcome", "municipality", "elevation")


@query(
    "select user_id % 20 as k, count(*) as n, epoch_us(min(ts)) as first_us, round(arg_max(value, event_id), 6) as mean, round(max(value), 6) as peak, max(event_id) as seq from events where value is not null group by 1",
)
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters upserted by micro-batches, the newest version read back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value is not null")
    one = e.select((F.col("user_id") % 20).alias("k"), F.lit(1).cast("long").alias("n"), F.col("ts").alias("first_ts"), F.col("value").alias("mean"), F.col("value").alias("peak"), F.col("event_id").alias("seq"))
    path = scratch(spark)
    table = upserts.counter_table(spark, f"{path}/table", ["k"], buckets=8, most_parts=1)
    for _ in streams.arriving(one, f"{path}/in", "first_ts", 4):
        rows = spark.readStream.schema(one.schema).parquet(f"{path}/in")
        upserts.counter_stream(rows, table, f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read().select("k", "n", telemetry.micros("first_ts").alias("first_us"), r6("mean", "mean"), r6("peak", "peak"), "seq")


@query(
    """with windows as (select device, epoch_us(ts) // 600000000 * 600000000 + 600000000 - 600000000 * i as until_us from f_moves, (values (0), (-1)) v(i)),
last as (select max(epoch_us(ts)) - 600000000 as mark from f_moves)
select device, until_us, round(count(*) * 60.0 / 1200, 6) as per_minute from windows where until_us <= (select mark from last) group by all""",
    "f_moves",
)
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a minute in sliding windows that the watermark has closed."""
    rows = adapter(spark, sf_dir, "f_moves").select("device", "ts")
    r = streams.run_available(rows, lambda s: streams.rate_stream(s, "device", 1200, 600))
    return r.select("device", telemetry.micros("until").alias("until_us"), r6("per_minute", "per_minute"))


@query(
    f"""with cells as (select {S.snap('lat')} as s_lat, {S.snap('lon')} as s_lon, epoch_us(ts) as t from f_points), span as (select min(t) as low, (max(t) - min(t)) // 3 + 1 as step from cells),
parts as (select s_lat, s_lon, (t - low) // step as part, max(t) over (partition by (t - low) // step) as now from cells, span), mine as (select distinct s_lat, s_lon, part, now from parts where {S.in_box('s_lat', 's_lon')}),
one as (select * from mine where part = 0), two as (select m.* from mine m left join one o using (s_lat, s_lon) where m.part = 1 and (o.now is null or o.now < m.now - 864000000000)),
three as (select m.* from mine m left join one o using (s_lat, s_lon) left join two w using (s_lat, s_lon) where m.part = 2 and greatest(coalesce(o.now, 0), coalesce(w.now, 0)) < m.now - 864000000000)
select s_lat, s_lon, max(now) as fetched_us, count(*) as lookups from (select * from one union all select * from two union all select * from three) group by all""",
    "f_points",
)
def stream_cell_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells looked up by a stream of points, once in ten days each: the last time, and how often over all runs."""
    rows, path = adapter(spark, sf_dir, "f_points").select("lat", "lon", "ts"), scratch(spark)
    table = upserts.cell_table(spark, f"{path}/cells", buckets=8, most_parts=1)

    def answer(cells: DataFrame) -> DataFrame:
        cells.write.mode("append").parquet(f"{path}/asked")
        return cells.withColumn("status", F.lit("ok"))

    for _ in streams.arriving(rows, f"{path}/in", "ts", 3):
        arrived = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        upserts.lookup_stream(arrived, table, answer, f"{path}/checkpoint", 10).trigger(availableNow=True).start().awaitTermination()
    asked = spark.read.parquet(f"{path}/asked").groupBy("s_lat", "s_lon").agg(F.count("*").alias("lookups"))
    return table.read().join(asked, ["s_lat", "s_lon"]).select("s_lat", "s_lon", telemetry.micros("fetched_at").alias("fetched_us"), "lookups")


from . import inputs  # noqa: E402, F401  registers its queries
