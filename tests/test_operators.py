"""Operators on small tables: brute force, edges, plans."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from placestream.functions import geo
from placestream.operators import hits, logs, nearest, points, quality, reports, telemetry
from placestream.sources import tables
from placestream.sources.adapters import adapter
from placestream.streaming import streams


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("around", [(47.0, 8.0), (0.0, 179.99), (-70.0, -179.95), (84.0, 10.0)])
def test_nearest_equals_brute_force(spark, around):
    rng = random.Random(3)
    wrap = lambda x: (x + 180) % 360 - 180
    spot = lambda: (around[0] + rng.uniform(-0.4, 0.4), wrap(around[1] + rng.uniform(-0.9, 0.9)))
    pts, plc = [spot() for _ in range(150)], [spot() for _ in range(60)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(pts)], "point_id long, lat double, lon double")
    c = spark.createDataFrame([(i, f"p{i}", *x) for i, x in enumerate(plc)], "place_id long, name string, lat double, lon double")
    for most in (100, 10):  # broadcast, and joined by cell
        got = {r.point_id: r.place_id for r in nearest.nearest_place(p, c, broadcast_places=most).collect()}
        for i, x in enumerate(pts):
            best = min((km(x, y), j) for j, y in enumerate(plc))
            assert got[i] == (best[1] if best[0] <= 8 else None)


def test_nearest_ties_take_the_earlier_place_and_nulls_stay(spark):
    p = spark.createDataFrame([(1, 47.0, 8.0), (2, None, 8.0), (3, 89.0, 8.0)], "point_id long, lat double, lon double")
    c = spark.createDataFrame([(5, "b", 47.01, 8.0), (4, "a", 47.01, 8.0)], "place_id long, name string, lat double, lon double")
    got = {r.point_id: r.place_id for r in nearest.nearest_place(p, c).collect()}
    assert got == {1: 4, 2: None, 3: None}


def test_nearest_is_an_equi_join(spark, data_dir):
    plan = nearest.nearest_place(adapter(spark, data_dir, "f_points").withColumnRenamed("event_id", "point_id"), adapter(spark, data_dir, "f_places"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan
    assert "Python" not in plan


def test_first_current_candidate_decides(spark):
    rows = [(1.0, 1.0, 0, "old", "BE", False), (1.0, 1.0, 1, "Thun", "BE", True), (1.0, 1.0, 2, "x", "ZH", True), (2.0, 2.0, 0, None, "BE", True), (2.0, 2.0, 1, "y", "BE", True), (3.0, 3.0, 0, "z", "BE", False), (4.0, 4.0, None, None, None, None)]
    got = {r.s_lat: (r.outcome, r.municipality) for r in points.resolve_cells(spark.createDataFrame(rows, "s_lat double, s_lon double, pos int, name string, canton string, is_current boolean")).collect()}
    assert got == {1.0: ("hit", "Thun"), 2.0: ("border_water", None), 3.0: ("border_water", None), 4.0: ("abroad", None)}


def test_lookup_responses(spark):
    body = '{"results":[{"attributes":{"gemname":"Thun","kanton":"BE","gde_nr":942,"is_current_jahr":true}}]}'
    got = points.parse_candidates(spark.createDataFrame([(1.0, 1.0, body), (2.0, 2.0, '{"results":[]}'), (3.0, 3.0, "broken")], "s_lat double, s_lon double, body string")).collect()
    assert sorted((r.s_lat, r.name) for r in got) == [(1.0, "Thun"), (2.0, None), (3.0, None)]


def test_refused_points_in_order(spark):
    rows = [("47", "8", None), ("abc", "999", "not_numbers"), (None, "8", "not_numbers"), ("NaN", "8", "not_finite"), ("91", "8", "out_of_range"), ("90", "-180", None)]
    got = spark.createDataFrame(rows, "lat string, lon string, want string").withColumn("got", points.validation_reason(F.col("lat"), F.col("lon"))).collect()
    assert all(r.got == r.want for r in got)


def test_log_counts_misses_and_clears(spark):
    t = lambda i: f"2024-01-01 00:00:{i:02d}"
    rows = [(1, 1, t(1), False, True, "BE"), (2, 1, t(2), False, True, "BE"), (3, 1, t(3), False, True, "ZH"), (4, 1, t(4), False, False, None), (5, 1, t(5), False, False, None), (6, 2, t(6), False, True, "BE"), (7, 2, t(7), True, None, None)]
    log = spark.createDataFrame(rows, "event_id long, user_key long, ts string, is_clear boolean, is_hit boolean, canton string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.user_key: (r.throw_count, r.cantons_collected, r.dart_skins_unlocked) for r in logs.user_properties(log).collect()}
    assert got == {1: (5, 2, 2), 2: (0, 0, 1)}


def test_empty_log(spark):
    log = spark.createDataFrame([], "event_id long, user_key long, ts timestamp, is_clear boolean, is_hit boolean, canton string")
    assert logs.canton_milestones(log).count() == logs.skin_milestones(log).count() == logs.user_properties(log).count() == 0


def test_consent_cases(spark):
    cookie = lambda j: "a=b; ow_consent=" + j
    rows = [(None, False, None, "granted"), (None, True, None, "denied"), (None, False, "1", "denied"), (cookie("%7B%22analytics_storage%22%3A%22granted%22%7D"), True, None, "denied"), (cookie("%7B%22analytics_storage%22%3A%22denied%22%7D"), False, None, "denied"), (cookie("broken"), False, None, "granted"), (cookie("null"), False, None, "granted"), (cookie("%5B1%5D"), False, None, None), (cookie("%zz"), False, None, "granted")]
    got = hits.resolve_consent(spark.createDataFrame(rows, "cookie string, gpc boolean, dnt string, want string"), dnt="dnt").collect()
    assert [r.analytics_storage for r in got] == [r[3] for r in rows]


def test_event_limits(spark):
    params = lambda n: "{" + ",".join(f'"k{i}":1' for i in range(n)) + "}"
    rows = [("n" * 40, params(25), False), ("n" * 41, params(1), True), ("n", params(26), True), ("n", None, False), ("n", "{}", False)]
    got = hits.tag_dropped(spark.createDataFrame(rows, "name string, params string, want boolean")).collect()
    assert all(r.will_be_dropped == r.want for r in got)


def test_vocabularies_stay_apart(spark):
    ours = spark.createDataFrame([("page_view",), ("x_server",)], "name string")
    theirs = spark.createDataFrame([("og_unfurl_server",)], "name string")
    assert [r.name for r in hits.unknown_events(ours).collect()] == ["x_server"]
    assert [r.name for r in hits.vocabulary_overlap(hits.all_hits(ours, theirs)).collect()] == ["x_server"]


def test_stored_logs_and_settings(spark):
    states = spark.createDataFrame([(1, '{"a":1}'), (2, "[]"), (3, '[{"id":"a","zyt":1,"wurf":{"art":"preich","kanton":"BE"}}]'), (4, None), (5, "[broken")], "user_key long, json string")
    assert [(r.user_key, r.entry_id) for r in tables.read_throw_log(states).collect()] == [(3, "a")]
    assert {r.view for r in tables.read_settings(states).collect()} == {"charte"}


def test_snapshot_is_written_whole_or_not(spark, tmp_path):
    bad = spark.createDataFrame([("a", "miss")], "name string, status string")
    good = spark.createDataFrame([("a", "ok")], "name string, status string")
    heights = spark.createDataFrame([("Zug", 1), ("Ärmel", 2), ("Bern", 3)], "name string, metres int")
    path = str(tmp_path / "s")
    assert quality.write_snapshot(bad, heights, path) == 1
    assert not (tmp_path / "s").exists()
    assert quality.write_snapshot(good, heights, path) == 0
    assert [r.name for r in spark.read.parquet(path).collect()] == ["Ärmel", "Bern", "Zug"]


def test_catalog_types_are_checked(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="catalog"):
        tables.load_catalog(spark, str(tmp_path / "c"))


def test_counter_reset_and_first_sample(spark):
    rows = [(1, 0, 10), (2, 1, 30), (3, 2, 5), (4, 2, 9)]
    s = spark.createDataFrame(rows, "event_id long, s long, ticks long").select("event_id", F.timestamp_seconds("s").alias("ts"), "ticks", F.lit("h").alias("host"))
    assert [r.rate for r in telemetry.counter_rate(s).orderBy("event_id").collect()] == [0.0, 20.0, None, None]


def test_upserts_are_safe_to_replay(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 5, 1.0, 3.0, 1), (1, 3, 4, 2.0, 2.0, 2)], "k int, n long, first_ts long, mean double, peak double, seq long")
    got = telemetry.merge_counters(rows.limit(0), rows, ["k"]).first()
    assert (got.n, got.first_ts, got.mean, got.peak) == (5, 4, 2.0, 3.0)


def test_export_has_a_header(spark, tmp_path):
    telemetry.export_samples(spark.range(3), str(tmp_path / "x"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).columns == ["id"]


def test_rate_stream_counts_windows(spark):
    rows = spark.createDataFrame([(1, i) for i in range(0, 120, 5)], "k int, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    out = streams.run_available(rows, lambda s: streams.rate_stream(s, "k", watermark="0 seconds"))
    assert out.agg(F.max("per_minute")).first()[0] == 12.0


def test_hits_are_read_alike_from_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"hit_id":1,"user_id":2,"ts_ms":1704067200000,"name":"page_view","params":"{\\"a\\":1}"}\n{broken\n')
    batch = tables.read_hits(spark, str(tmp_path / "in"))
    assert batch.schema == tables.read_hits(spark, str(tmp_path / "in"), stream=True).schema
    rows = sorted(batch.select("hit_id", F.col("ts").cast("string").alias("ts"), F.try_variant_get("params", "$.a", "int").alias("a"), "_corrupt_record").collect(), key=lambda r: r.hit_id or 0)
    assert (rows[0].hit_id, rows[0]["_corrupt_record"]) == (None, "{broken")
    assert (rows[1].ts, rows[1].a) == ("2024-01-01 00:00:00", 1)


def test_cells_are_looked_up_again_after_their_time(spark):
    rows = spark.createDataFrame([(47.00001, 8.0), (47.0, 8.00004), (46.5, 8.0), (40.0, 8.0)], "lat double, lon double")
    known = spark.createDataFrame([(46.5, 8.0, 10), (47.0, 8.0, 40)], "s_lat double, s_lon double, age int").withColumn("fetched_at", F.expr("timestamp'2024-03-01' - make_interval(0, 0, 0, age)"))
    got = points.distinct_cells(rows, known, F.lit("2024-03-01").cast("timestamp")).collect()
    assert [(r.s_lat, r.s_lon) for r in got] == [(47.0, 8.0)]


def test_failed_lookups_are_errors(spark):
    ok, failed = points.lookup_errors(spark.createDataFrame([(1, "ok"), (2, "503"), (3, None)], "id int, status string"))
    assert [r.id for r in ok.collect()] == [1]
    assert sorted(r.id for r in failed.collect()) == [2, 3]


def test_snapshot_texts(spark):
    assert sorted(tuple(r) for r in tables.read_snapshot(spark.createDataFrame([('{"Thun": 560, "Bern": 540}',)], "json string")).collect()) == [("Bern", 540), ("Thun", 560)]


def test_quantiles_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr(reports, "_SMALL", 500)
    rng = random.Random(4)
    rows = [(g, rng.choice([rng.random() * 100, 7.0, None])) for g in ("a", "b", None) for _ in range(3 if g == "b" else 4000)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q, upper in ((0.5, False), (0.5, True), (0.95, False), (0.0, False), (1.0, False)):
        got = {r.g: r.x for r in reports.quantile(df, ["g"], "v", q, "x", upper).collect()}
        for g in ("a", "b", None):
            v = sorted(x for k, x in rows if k == g and x is not None)
            h = (len(v) - 1) * q
            want = v[len(v) // 2] if upper else v[int(h)] + (h - int(h)) * (v[min(int(h) + 1, len(v) - 1)] - v[int(h)]) if v else None
            assert got[g] is want is None or abs(got[g] - want) < 1e-9
        assert got["none"] is None


def test_isolation_equals_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, 46 + rng.random() * (0.01 if i % 2 else 2), 7 + rng.random() * (0.01 if i % 2 else 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "place_id long, lat double, lon double")
    km = df.alias("a").crossJoin(df.alias("b")).filter("a.place_id <> b.place_id").select("a.place_id", geo.haversine_km("a.lat", "a.lon", "b.lat", "b.lon").alias("km")).groupBy("place_id").agg(F.min("km").alias("km"))
    want = {r.place_id: r.km if r.km <= 20 else None for r in km.collect()}
    got = {r.place_id: r.km for r in nearest.place_isolation(df, 20.0).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] is want[k] is None or abs(got[k] - want[k]) < 1e-9 for k in want)


def test_events_of_throws_keep_their_contract(spark):
    rows = [(1, "hit", "BE", "Thun", 560, True, 12.4, "N", 31.5, "clean"), (2, "hit", "", "Bern", None, False, 0.2, "S", 7.0, "sloppy"), (3, "abroad", None, None, None, None, 300.0, "W", 4.2, "shank"), (4, "border_water", None, None, None, None, 90.0, "E", 4.0, "clean")]
    df = spark.createDataFrame(rows, "id long, outcome string, canton string, municipality string, elevation int, water boolean, km double, direction string, upstream_ms double, throw_style string")
    server, client = points.resolved_server_events(df).collect(), points.completed_events(df).collect()
    assert [r.params for r in server[1:3]] == ['{"art":"preich","upstream_ms":7,"kanton":"","wasser":false,"distanz_km":0,"richtig":"S"}', '{"art":"dernaebe","upstream_ms":4,"grund":"usland"}']
    assert client[3].params == '{"outcome":"dernaebe","throw_quality":"sufer","miss_reason":"grenzwasser"}'
    for events in (points.resolved_server_events(df), points.completed_events(df)):
        assert [r.p for r in events.select(hits.contract_problems(F.col("name"), F.col("params")).alias("p")).collect()] == [[]] * 4


def test_a_snapshot_that_cannot_be_replaced_stays():
    class Files:
        def __init__(self, refuse):
            self.have, self.refuse = {"now": "first", "fresh": "second"}, refuse

        def exists(self, name):
            return name in self.have

        def rename(self, a, b):
            if (a, b) in self.refuse:
                return False
            self.have[b] = self.have.pop(a)
            return True

        def delete(self, name, _):
            self.have.pop(name, None)

    good = Files([])
    quality._swap(good, "fresh", "now", "old")
    assert good.have == {"now": "second"}
    for refuse in ([("fresh", "now")], [("now", "old")]):
        files = Files(refuse)
        with pytest.raises(OSError, match="cannot be replaced"):
            quality._swap(files, "fresh", "now", "old")
        assert files.have == {"now": "first"}
