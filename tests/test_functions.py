"""Column functions on literal rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from placestream.functions import geo, labels, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_halves_round_upwards(spark):
    got = values(spark, [(-2.5,), (2.5,), (0.49,), (-0.5,)], "x double", geo.round_half_up("x"))
    assert [g[0] for g in got] == [-2, 3, 0, 0]


@pytest.mark.parametrize(("lat", "lon", "km"), [(47.3769, 8.5417, 95.5), (46.2044, 6.1432, 129.5)])
def test_distances_from_the_origin(spark, lat, lon, km):
    assert values(spark, [(lat, lon)], "a double, b double", F.round(geo.haversine_km(46.948, 7.4474, "a", "b"), 1))[0][0] == km


def test_antipodes_do_not_break_the_distance(spark):
    d = values(spark, [(0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double", geo.haversine_km("a", "b", "c", "d"))[0][0]
    assert math.isclose(d, math.pi * 6371, rel_tol=1e-9)


def test_sectors_at_their_edges(spark):
    got = values(spark, [(0.0,), (22.4,), (22.5,), (45.0,), (337.4,), (337.6,)], "b double", geo.compass_sector("b"))
    assert [g[0] for g in got] == ["north", "north", "northeast", "northeast", "northwest", "north"]


def test_box_edges_are_inside(spark):
    rows = [(45.818, 5.9559, True), (47.8085, 10.4921, True), (45.818 - 1e-6, 7.0, False), (46.0, 10.4921 + 1e-6, False), (None, 7.0, None)]
    got = values(spark, rows, "lat double, lon double, want boolean", geo.in_bbox("lat", "lon"), "want")
    assert all(a == b for a, b in got)


def test_destination_is_as_far_as_it_was_sent(spark):
    p = geo.destination_point(46.948, 7.4474, "km", "turn")
    rows = [(float(k), float(t)) for k in (1, 50, 200) for t in (0, 77, 181, 300)]
    for km, turn, d, b in values(spark, rows, "km double, turn double", "km", "turn", geo.haversine_km(46.948, 7.4474, p["lat"], p["lon"]), geo.bearing_deg(46.948, 7.4474, p["lat"], p["lon"])):
        assert abs(km - d) < 1e-6
        assert min(abs(turn - b), 360 - abs(turn - b)) < 1e-6


def test_swiss_grid_reference(spark):
    g = values(spark, [(46.624, 8.041)], "lat double, lon double", geo.wgs84_to_lv95("lat", "lon"))[0][0]
    assert abs(g.easting - 2646134.28) < 0.3
    assert abs(g.northing - 1163815.47) < 0.3


def test_far_pixels_are_off_the_map(spark):
    view = geo.View()
    got = values(spark, [(640.0, 400.0), (640.0, -1e9), (float("nan"), 0.0)], "x double, y double", view.valid_landing("x", "y"))
    assert [g[0] for g in got] == [True, False, False]


def test_heatmap_clamps(spark):
    assert [g[0] for g in values(spark, [(-5.0,), (0.0,), (99.9,), (100.0,), (500.0,)], "x double", geo.heatmap_bucket("x", 100.0))] == [0, 0, 49, 49, 49]


def test_number_prefixes(spark):
    rows = [("46.6abc",), (" -3.5e2x",), (".5",), ("abc",), ("",), (None,), ("7",)]
    assert [g[0] for g in values(spark, rows, "s string", text.parse_float("s"))] == [46.6, -350.0, 0.5, None, None, None, 7.0]
    assert [g[0] for g in values(spark, [("502 Bad",), ("x1",), (None,)], "s string", text.error_status("s"))] == [502, None, None]


def test_point_parameters(spark):
    rows = [("46.9,7.4",), ("46.9,7.4,zz",), ("91,7",), ("46.9",), ("a,b",), (None,)]
    got = [g[0] for g in values(spark, rows, "s string", text.parse_point_param("s"))]
    assert [bool(g) for g in got] == [True, True, False, False, False, False]


def test_links(spark):
    rows = [("HTTPS://User@Other.Example.com:443/x",), ("http://site.example.com:8080/",), ("mailto:a@example.com",), ("/rel",), ("#h",), (None,)]
    got = values(spark, rows, "h string", text.link_fields("h", F.lit(" t "))["link_domain"], text.is_outbound("h", F.lit("site.example.com")))
    assert got == [("other.example.com", True), ("site.example.com", True), ("", False), ("", False), ("", False), ("", False)]


def test_cookies(spark):
    rows = [("_ga=GA1.1.1.2; x; _ga=GA1.1.3.4",), (" _ga = GA1.1.5.6 ",), ("_ga=broken",), ("",), (None,)]
    assert [g[0] for g in values(spark, rows, "c string", text.client_id("c"))] == ["3.4", "5.6", None, None, None]
    rows = [("_ga_S=GS2.1.s99$o1",), ("_ga_S=GS1.1.77.5",), ("_ga_T=GS1.1.77.5",)]
    assert [g[0] for g in values(spark, rows, "c string", text.session_id("c", "S"))] == ["99", "77", None]


def test_water_names(spark):
    rows = [("Thunersee", True), ("Oeschinenseeli", True), ("LAC Léman", True), ("Lago", True), ("Lacé", True), ("Lachen", False), ("Seen", False), ("Thun", False)]
    assert all(a == b for a, b in values(spark, rows, "n string, w boolean", text.is_water("n"), "w"))


def test_remarks_at_their_limits(spark):
    rows = [(True, 4000, 5.0, "BE", "water"), (False, 3500, 5.0, "BE", "glacier"), (False, 3499, 5.0, "BE", "high_alpine"), (False, 300, 5.0, "BE", "low"), (False, 301, 10.0, "BE", "close"), (False, None, 200.0, "ZH", "far_200"), (False, 1499, 199.0, "ZH", "canton_ZH"), (False, 400, 50.0, "JU", "other")]
    assert all(a == b for a, b in values(spark, rows, "w boolean, e int, k double, c string, want string", labels.reaction_label("w", "e", "k", "c"), "want"))


def test_drags(spark):
    rows = [(6.0, 8.0), (0.0, 9.99), (300.0, 0.0), (None, None)]
    f = labels.drag_features(F.lit(0.0), F.lit(0.0), "x", "y", F.lit("back"))
    got = values(spark, rows, "x double, y double", f["enough"], f["force"], labels.drag_outcome("x", "y"))
    assert [g[2] for g in got] == ["throw_input_method", "throw_abandoned", "throw_input_method", "no_move"]
    assert got[2][1] == 1.0


def test_links_follow_the_rules_of_browsers(spark):
    rows = [
        ("https://other.com/a b", "other.com", True), ("https://other.com/a|b", "other.com", True), ("https://other.com?q={y}", "other.com", True), ("https://other.com/100%", "other.com", True), ("HTTPS://u:p@Own.com:443/x", "own.com", False), ("http://own.com:8080", "own.com", True),
        ("https:own.com", "own.com", False), ("https:\\\\other.com\\x", "other.com", True), ("https://", "", False), ("mailto:a@b.c", "", False), ("tel:1", "", False), ("#x", "", False), ("/rel", "", False), (None, "", False), ("https://a b/x", "", False), ("http://x:70000/", "", False), ("ftp://f.com/x", "f.com", False),
    ]
    df = spark.createDataFrame(rows, "href string, domain string, outbound boolean")
    got = df.select("domain", text.link_fields("href", F.lit(" x "))["link_domain"].alias("d"), "outbound", text.is_outbound("href", F.lit("own.com")).alias("o")).collect()
    assert [(r.d, r.o) for r in got] == [(r.domain, r.outbound) for r in got]


def test_hosts_are_written_as_browsers_write_them(spark):
    rows = [
        ("https://münchen.example/x", "xn--mnchen-3ya.example"), ("https://例え.jp/", "xn--r8jz45g.jp"), ("https://exa%6Dple.com/", "example.com"), ("https://m%C3%BCnchen.example/", "xn--mnchen-3ya.example"), ("http://a%2fb/", ""), ("http://a%zz/", ""),
        ("http://0x7f.1/", "127.0.0.1"), ("http://192.168.257/", "192.168.1.1"), ("http://0300.0250.1/", "192.168.0.1"), ("http://4294967295/", "255.255.255.255"), ("http://4294967296/", ""), ("http://256.1.1.1/", ""), ("http://1.2.3.4.5/", ""),
        ("http://09.1/", ""), ("http://1.2.3.4./", "1.2.3.4"), ("http://x.0x/", ""), ("http://[::1]:80/x", "[::1]"), ("http://a:99999999999/", ""), ("http://1a.example/", "1a.example"),
    ]
    got = values(spark, [(r[0],) for r in rows], "h string", text.link_fields("h", F.lit("\u00a0 t\ufeff\u2003"))["link_domain"], text.link_fields("h", F.lit("\u00a0 t\ufeff\u2003"))["link_text"])
    assert [g[0] for g in got] == [r[1] for r in rows]
    assert {g[1] for g in got} == {"t"}


def test_numbers_after_any_white_space(spark):
    rows = [("\u00a0\u20037.5m",), ("\ufeff-2",), ("\u200b3",), ("\x0b\t4e1",)]
    assert [g[0] for g in values(spark, rows, "s string", text.parse_float("s"))] == [7.5, -2.0, None, 40.0]
    assert [g[0] for g in values(spark, rows[:2], "s string", text.parse_int("s"))] == [7, -2]
