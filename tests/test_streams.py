"""Streams against brute force: rows out of order within the watermark, restarts, idle keys, upserts and replays."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from placestream.operators import telemetry
from placestream.streaming import ordered, streams, upserts


@pytest.fixture
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def shuffled(spark, rows, schema, late=40):
    """Rows (at seconds, ...) with a time of arrival up to ``late`` seconds after their own."""
    rng = random.Random(3)
    df = spark.createDataFrame([(*r, r[0] + rng.random() * late) for r in rows], f"at double, {schema}, arrives double")
    return df.withColumns({"ts": F.timestamp_micros(F.floor(F.col("at") * 1e6)), "arrived": F.timestamp_micros(F.floor(F.col("arrives") * 1e6))})


def log_rows(n=260):
    rng, rows = random.Random(8), []
    for i in range(n):
        clear = rng.random() < 0.02
        hit = not clear and rng.random() < 0.9
        rows.append((rng.randrange(3000) / 10, i, rng.choice([1, 2]), clear, hit, rng.choice(["BE", "ZH", "VD", "", None, "TI", "GR"]) if hit else None))
    return rows


LOG = "event_id long, user_key long, is_clear boolean, is_hit boolean, canton string"


def slow_milestones(rows, n, total, until):
    logs: dict = {}
    for at, i, user, clear, hit, canton in sorted(rows, key=lambda r: (r[0], r[1])):
        log = logs.setdefault(user, [])
        if clear:
            log.clear()
            if int(at) + 1 <= until:
                yield ("props", user, i, 0, 0, 1)
            continue
        last = log[-n:]
        have = {c for c in last if c}
        canton = canton if hit and canton else ""
        log.append(canton)
        if int(at) + 1 > until:
            continue
        if canton and canton not in have:
            yield ("canton", user, i, canton, len(have) + 1)
            if len(have) + 1 == total:
                yield ("complete", user, i, "all", len(last) + 1)
        for skin, threshold in ordered.C.SKINS:
            if threshold and threshold == len(last) + 1:
                yield ("skin", user, i, skin, threshold)
        now = log[-n:]
        yield ("props", user, i, len(now), len(set(now) - {""}), sum(len(now) >= t for _, t in ordered.C.SKINS))


def test_logs_in_any_order(few_tasks):
    rows = log_rows()
    df = shuffled(few_tasks, rows, LOG)
    want = list(slow_milestones(rows, 16, 5, max(r[0] for r in rows) - 60))
    got = streams.run_available(df, lambda s: ordered.milestone_stream(s, 16, 5, watermark="60 seconds"), order="arrived").collect()
    assert sorted((r.kind, r.user_key, r.event_id, r.value, r["count"]) for r in got) == sorted(w for w in want if w[0] != "props")
    assert {r.kind for r in got} == {"canton", "complete", "skin"}
    got = streams.run_available(df, lambda s: ordered.user_properties_stream(s, 16, watermark="60 seconds", slot_ms=5), order="arrived", slices=2).collect()
    exact = [w for w in slow_milestones(rows, 16, 5, max(r[0] for r in rows) - 58) if w[0] == "props"]
    ours = sorted(("props", *r) for r in got)
    assert set(w for w in want if w[0] == "props") <= set(ours) <= set(exact)  # finer slots are released a little sooner


def test_rates_row_by_row_in_any_order(few_tasks):
    rng = random.Random(5)
    rows = [(round(rng.choice([rng.random() * 30, 200 + rng.random() * 300]), 1), i, rng.choice(["a", "b"])) for i in range(300)]
    df = shuffled(few_tasks, rows, "event_id long, k string")
    until = max(r[0] for r in rows) - 60
    got = streams.run_available(df, lambda s: ordered.exact_rate_stream(s, "k", 20, watermark="60 seconds"), order="arrived")
    batch = telemetry.rolling_rate(df, "k", 20).filter(F.floor("at") + 1 <= until)
    key = lambda r: (r.k, r.event_id, r.n, None if r.rate is None else round(r.rate, 6))
    assert sorted(map(key, got.collect())) == sorted(map(key, batch.select("k", "event_id", "n", "rate").collect()))


def test_a_key_at_rest_forgets_and_late_rows_are_dropped(few_tasks, tmp_path):
    hits = lambda *rows: shuffled(few_tasks, [(float(at), i, 1, v) for at, i, v in rows], "hit_id long, user_id long, internal_value string", 0).drop("arrives", "arrived")
    source, out = str(tmp_path / "in"), []
    steps = [hits((1, 1, "1"), (2, 2, None)), hits((50, 3, None)), hits((1, 9, "1"), (400, 4, None)), hits((900, 5, None))]
    for step in steps:
        step.coalesce(1).write.mode("append").parquet(source)
        rows = few_tasks.readStream.schema(step.schema).parquet(source)
        flags = ordered.internal_flag_stream(rows, watermark="10 seconds", idle_ms=100_000)
        writer = flags.writeStream.foreachBatch(lambda b, _: out.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == [(1, 1, False), (1, 2, True), (1, 3, True), (1, 4, False)]  # 9 came too late, 4 after a rest, 5 still waits


COUNTERS = "k long, n long, first_ts long, mean double, peak double, seq long"


def bytes_of(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_batches_write_what_they_touch(spark, tmp_path):
    table = upserts.counter_table(spark, f"file://{tmp_path}/t", ["k"], buckets=16, most_parts=2)
    assert table.read() is None
    want: dict = {}
    for epoch in range(9):
        keys = list(range(4_000)) + [None] if epoch == 0 else [epoch % 3, 7, None]
        rows = [(k, 2, 100 - epoch, float(epoch) if epoch % 2 else None, float(-epoch), epoch) for k in keys]
        table.upsert(spark.createDataFrame(rows, COUNTERS), epoch)
        for k, n, first, mean, peak, seq in rows:
            old = want.get(k, (0, 999, None, -99.0, -1))
            want[k] = (old[0] + n, min(old[1], first), old[2] if mean is None else mean, max(old[3], peak), max(old[4], seq))
        if epoch == 5:  # a replay of a batch, after it was written whole
            table.upsert(spark.createDataFrame(rows, COUNTERS), epoch)
        got = {r.k: (r.n, r.first_ts, r.mean, r.peak, r.seq) for r in table.read().collect()}
        assert got == want
    parts = table.manifest(table.newest())
    assert sum(len(p) for p in parts.values()) < 16 + 4 * 3
    small, large = bytes_of(tmp_path / "t/parts/e8"), bytes_of(tmp_path / "t/parts/e0")
    assert small < large / 2
    assert sorted(p.name for p in (tmp_path / "t/manifests").iterdir()) == ["e7", "e8"]


def test_readers_see_whole_batches_only(spark, tmp_path):
    table = upserts.counter_table(spark, f"file://{tmp_path}/t", ["k"], buckets=4)
    one = spark.createDataFrame([(1, 1, 1, 1.0, 1.0, 1)], COUNTERS)
    table.upsert(one, 0)
    one.withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"file://{tmp_path}/t/parts/e1")  # a batch that failed before its manifest
    assert table.read().first().n == 1
    table.upsert(one, 1)
    assert table.read().first().n == 2


def test_counter_stream_adds_up(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, 1, i, float(i), float(i), i) for i in range(30)], COUNTERS)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = upserts.counter_table(spark, f"file://{tmp_path}/t", ["k"], most_parts=1)
    upserts.counter_stream(stream, table, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.k, r.n) for r in table.read().collect()) == [(0, 10), (1, 10), (2, 10)]


def test_a_cell_is_looked_up_once_in_its_time(spark, tmp_path):
    table, asked = upserts.cell_table(spark, f"file://{tmp_path}/cells", buckets=8, most_parts=1), []

    def answer(cells):
        asked.append(sorted((r.s_lat, r.s_lon) for r in cells.collect()))
        return cells.withColumn("body", F.concat(F.lit("answer "), F.lit(len(asked))))

    def points(day, *spots):
        return spark.createDataFrame([(lat, lon, day) for lat, lon in spots], "lat double, lon double, day int").withColumn("ts", F.timestamp_seconds(F.col("day") * 86_400))

    a, b, c = (47.0, 8.0), (46.5, 7.5), (46.9, 7.4)
    steps = [points(1, a, (47.00001, 8.0), b), points(20, a, c), points(30, a, b), points(31, a), points(32, a, b, (10.0, 10.0)), points(90, a, b, c)]
    for epoch, step in enumerate(steps):
        upserts.look_up(step, table, answer, epoch)
        if epoch == 4:
            upserts.look_up(step, table, answer, epoch)  # replayed
    assert asked == [sorted([a, b]), [c], [], [], sorted([a, b]), sorted([a, b]), sorted([a, b, c])]
    assert {r.body for r in table.read().collect()} == {"answer 7"}
    upserts.look_up(points(91).limit(0), table, answer, 6)
    assert table.read().count() == 3
