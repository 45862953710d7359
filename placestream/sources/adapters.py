"""Domain-shaped inputs derived from the driver's tables, as SQL that both engines run unchanged.

Five users of the tables make one user, host or device here, so that a group's log is longer than
the operators' windows while groups grow in number with the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "f_points": """select event_id, cast(floor(user_id / 5) as bigint) as user_key, ts,
 45.7 + cast((k * 7919) % 22000 as double) / 10000.0 as lat,
 5.9 + cast((k * 104729) % 47000 as double) / 10000.0 as lon
 from (select *, event_id % 4000 as k from events) e""",
    "f_places": """select s_suppkey as place_id, s_name as name,
 45.85 + cast((s_suppkey * 6007) % 19000 as double) / 10000.0 as lat,
 6.0 + cast((s_suppkey * 10007) % 44000 as double) / 10000.0 as lon, s_nationkey as canton_id from supplier""",
    "f_cells": """select distinct floor(lat * 10000 + 0.5) / 10000 as lat, floor(lon * 10000 + 0.5) / 10000 as lon, event_id % 4000 as k from f_points""",
    "f_candidates": """select c.lat, c.lon, p.pos, case when (k + p.pos) % 5 = 0 then null when (k + p.pos) % 7 = 0 then 'place_' || cast((k + p.pos) % 40 as varchar(20)) || 'see' else 'place_' || cast((k + p.pos) % 40 as varchar(20)) end as name,
 case when k % 3 = 0 then 'ZH' when k % 3 = 1 then 'K' || cast(k % 26 as varchar(20)) else 'BE' end as canton, (k + p.pos) % 3 = 0 as is_current
 from f_cells c join (select 0 as pos, 1 as quarter union all select 0, 2 union all select 1, 2 union all select 0, 3 union all select 1, 3 union all select 2, 3) p on p.quarter = k % 4""",
    "f_elevations": """select lat, lon, cast((k * 37) % 4000 as int) as metres from f_cells where k % 9 <> 0""",
    "f_log": """select event_id, cast(floor(user_id / 5) as bigint) as user_key, ts, event_id % 997 = 0 as is_clear, event_id % 6 <> 0 as is_hit,
 case when event_id % 6 = 0 then null when event_id % 401 = 0 then 25 else (event_id * 31) % 25 end as canton_id from events""",
    "f_hits": """select event_id as hit_id, user_id, ts, event_type,
 case event_id % 5 when 0 then null when 1 then '_ga=GA1.1.' || cast(event_id as varchar(20)) || '.' || cast(user_id as varchar(20)) || '; _ga_S=GS2.1.s' || cast(event_id % 97 as varchar(20)) || '$o1'
  when 2 then '_ga=broken' when 3 then '_ga=GA1.1.1.2; x; _ga=GA1.1.3.4; _ga_S=GS1.1.77.5.1' else 'ow_consent=%7B%22analytics_storage%22%3A%22denied%22%7D' end as cookie,
 event_id % 11 = 0 as gpc, case event_id % 50 when 0 then 'ow_internal=1' when 25 then 'ow_internal=0' when 10 then 'ow_internal=2' else '' end as query, props from events""",
    "f_clicks": """select page_id, url, case page_id % 26 when 0 then url when 1 then 'https://other.example.com/x' when 2 then 'mailto:a@example.com' when 3 then '/rel' when 4 then 'https://other.com/a b' when 5 then 'https://other.com/a|b'
 when 6 then 'https://other.com/?q={y}' when 7 then 'https://other.com/100%' when 8 then 'HTTPS://User@Other.Example.com:443/x' when 9 then 'http://site.example.com:8080/' when 10 then 'https://site.example.com'
 when 11 then 'http:///three.example.com/' when 12 then 'https://' when 13 then 'tel:+41' when 14 then '#frag' when 15 then '  https://padded.example.com/  ' when 16 then 'ftp://files.example.com/x' when 17 then 'https://bad host/x'
 when 18 then 'https://site.example.com:443/y?x@z' when 19 then 'https://münchen.example/x' when 20 then 'https://exa%6Dple.com/' when 21 then 'http://0x7f.1/' when 22 then 'http://192.168.257/' when 23 then 'https://BÜCHER%2Eexample:8443/' when 24 then 'http://256.1.1.1/'
 else 'http://x.example.com:99999/' end as href from pages""",
    "f_raw_points": """select event_id, case event_id % 9 when 0 then 'abc' when 1 then 'NaN' when 2 then cast(lat + 60 as varchar(20)) when 3 then '46.6abc' when 4 then '-Infinity' when 5 then '' when 6 then '46.' else cast(lat as varchar(20)) end as lat,
 case event_id % 11 when 0 then null when 1 then 'Infinity' when 2 then '-190.5' when 3 then '7,4' when 4 then '.75e1' when 5 then '+8.25' else cast(lon as varchar(20)) end as lon from f_points""",
    "f_state": """select event_id, event_id as user_key, case event_id % 7 when 0 then null when 1 then '{"aasicht": 1' when 2 then '{"aasicht": "globus", "wurfart": "schlueder"}' when 4 then '{"ton": true, "x": [1]}' when 5 then '[]' when 6 then '"text"'
 else '[{"id": "a' || cast(event_id as varchar(20)) || '", "zyt": 1704067200000, "isPreich": true, "ziuName": "Hei", "wurf": {"art": "preich", "kanton": "BE", "gmeind": "Thun"}}, {"id": "b", "zyt": 1704067201000, "wurf": {"art": "dernaebe", "grund": "usland"}}]' end as json from events""",
    "f_texts": """select event_id, case event_id % 10 when 0 then '502 Bad Gateway' when 1 then 'no status' when 2 then '  404' when 3 then '-7.9e1 x' when 4 then '.5' when 5 then '+12.' when 6 then '1e3m' when 7 then '' when 8 then null else cast(event_id as varchar(20)) || '.25 m' end as t,
 case event_id % 6 when 0 then '46.9,7.4' when 1 then '91,7' when 2 then '46.9abc,7.4xyz,9' when 3 then '46.9' when 4 then ' -12.5 , 180 ' else 'a,b' end as point from events""",
    "f_responses": """select lat, lon, case k % 4 when 0 then '{"results": []}' when 3 then '{"results": [{"attr' else
 '{"results": [{"attributes": {"gemname": "p' || cast(k % 40 as varchar(20)) || '", "kanton": "BE", "gde_nr": ' || cast(k as varchar(20)) || ', "is_current_jahr": false}}'
 || case when k % 4 = 2 then ', {"attributes": {"gemname": "q", "is_current_jahr": true}}' else '' end || ']}' end as body from f_cells""",
    "f_traffic": """select event_id as hit_id, user_id, case event_id % 6 when 0 then 'page_view' when 1 then 'page_not_found' when 2 then 'outbound_click' when 3 then 'nav_click' when 4 then 'project_cta_click' else 'web_vitals' end as name,
 case when event_id % 6 in (0, 1, 5) then '/p' || cast(event_id % 14 as varchar(20)) end as page_path, case when event_id % 12 = 1 then 'https://ref.example.com/' end as referrer, case when event_id % 6 = 2 then 'd' || cast(event_id % 5 as varchar(20)) || '.example.com' end as link_domain,
 case when event_id % 6 = 3 then (case when event_id % 4 < 2 then 'header' else 'footer' end) end as nav_location, case when event_id % 6 = 4 then 'project' || cast(event_id % 3 as varchar(20)) end as project_slug, value, event_type from events""",
    "f_contract": """select event_id, case event_id % 12 when 0 then 'nav_click' when 1 then 'nav_click' when 2 then 'share_result' when 3 then 'share_result' when 4 then 'throw_completed' when 5 then 'web_vitals' when 6 then 'unknown_name' when 7 then 'panel_toggle' when 8 then 'panel_toggle' when 9 then 'page_not_found'
  when 10 then 'throw_api_error' else 'throw_resolved_server' end as name,
 case event_id % 12 when 0 then '{"link_url":"/a","link_text":"a","nav_location":"header"}' when 1 then '{"link_url":"/a","link_text":5,"nav_location":"side"}' when 2 then '{"share_method":"native","outcome":"shared","more":1}' when 3 then '{"share_method":"native"}'
  when 4 then '{"outcome":"preich","throw_quality":"sufer","elevation":null,"distance_km":12.5,"water":false,"miss_reason":"sea"}' when 5 then '{"metric_name":"LCP","metric_value":"12","metric_rating":"good","metric_id":"x","page_path":null}' when 6 then '{}' when 7 then '{"open":true}' when 8 then '{"open":"yes"}'
  when 9 then null when 10 then '{"status":"502"}' else '{"art":"preich","upstream_ms":' || cast(event_id % 500 as varchar(20)) || ',"hoechi":560}' end as params from events""",
    "f_throws": """select event_id, cast(event_id % 3 as double) / 2 as force, value * cos(cast(event_id as double)) as dx, value * sin(cast(event_id as double)) as dy, value,
 event_id % 14 = 0 as shank from events""",
    "f_counter": """select cast(floor(user_id / 5) as bigint) as host, ts, event_id, event_id * 3 % 5000 as ticks, case when event_id % 3 = 0 then value end as slow_value from events""",
    "f_moves": """select event_id, user_id, cast(floor(user_id / 5) as bigint) as device, ts, case event_type when 'view' then 'move' when 'click' then 'left_click' when 'purchase' then 'key' when 'signup' then 'scroll' else 'right_click' end as kind,
 cast((event_id * 31) % 2600 as double) - 100 as x, cast((event_id * 17) % 1500 as double) - 30 as y, value as dx, -value as dy,
 cast(event_id % 60 as int) as key_code, cast((event_id * 65536) % 4194304 as bigint) as flags, 'app' || cast(event_id % 7 as varchar(20)) as bundle_id from events""",
    "f_funnel": """select event_id as hit_id, user_id, user_id * 100 + cast(extract(day from ts) as int) as session_id, ts,
 case event_id % 8 when 0 then 'throw_started' when 1 then 'throw_input_method' when 2 then 'throw_completed' when 3 then 'throw_abandoned' when 4 then 'throw_off_map' when 5 then 'throw_api_error' when 6 then 'share_attempt' else 'share_result' end as name,
 case when event_id % 8 in (0, 3) then (case when event_id % 16 < 8 then 'drag' else 'fling' end) when event_id % 8 = 1 then (case event_id % 32 when 1 then 'tap' when 9 then 'keyboard' when 17 then 'drag' else 'fling' end) end as input_method,
 case when event_id % 8 = 7 then (case when event_id % 16 = 7 then 'native' else 'clipboard' end) end as share_method,
 case when event_id % 8 = 7 then (case event_id % 24 when 7 then 'shared' when 15 then 'copied' else 'failed' end) end as outcome from events""",
}
_TABLES = ("events", "supplier", "pages", "nation", "documents")


def needed(name: str) -> list[str]:
    """Adapters that ``name`` is built on, itself last."""
    out: list[str] = []
    for other in SQL:
        if other != name and re.search(rf"\b{other}\b", SQL[name]):
            out += [x for x in needed(other) if x not in out]
    return [*out, name]


def ctes(*names: str) -> str:
    """The adapters as common table expressions, without the leading WITH."""
    order: list[str] = []
    for n in names:
        order += [x for x in needed(n) if x not in order]
    return ",\n".join(f"{n} as ({SQL[n]})" for n in order)


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter as a DataFrame over the tables in ``sf_dir``."""
    text = f"with {ctes(*needed(name)[:-1])} {SQL[name]}" if len(needed(name)) > 1 else SQL[name]
    text = text.replace("varchar(20)", "string").replace("{", "{{").replace("}", "}}")  # braces mark tables below
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if re.search(rf"\b(from|join) {t}\b", text)}
    for t in tables:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **tables)
