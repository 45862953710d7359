"""Processors of keyed streams on a state that counts its calls: few a micro-batch, and right results in pages of any size."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from placestream.streaming import ordered


class Value:
    def __init__(self, count):
        self.count, self.value = count, None

    def get(self):
        self.count()
        return self.value

    def exists(self):
        self.count()
        return self.value is not None

    def update(self, value):
        self.count()
        self.value = value

    def clear(self):
        self.count()
        self.value = None


class Map:
    def __init__(self, count):
        self.count, self.values = count, {}

    def getValue(self, key):
        self.count()
        return self.values.get(key)

    def containsKey(self, key):
        self.count()
        return key in self.values

    def updateValue(self, key, value):
        self.count()
        self.values[key] = value

    def removeKey(self, key):
        self.count()
        self.values.pop(key, None)

    def clear(self):
        self.count()
        self.values.clear()

    def iterator(self):
        self.count()
        return iter(self.values.items())


class Handle:
    """The state and timers of one bucket, and its own times of expiry and watermark."""

    def __init__(self):
        self.calls, self.timers, self.states, self.now, self.fired = 0, set(), [], 0, 0

    def count(self):
        self.calls += 1

    def getValueState(self, name, schema):
        self.states.append(Value(self.count))
        return self.states[-1]

    def getMapState(self, name, key, schema):
        self.states.append(Map(self.count))
        return self.states[-1]

    def registerTimer(self, at):
        self.count()
        self.timers.add(at)

    def deleteTimer(self, at):
        self.count()
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.fired


def run(processor, batches, late_ms, key_of=lambda tie: "1"):
    """What a bucket gives, of key 1 alone or of the keys of each tie, for batches of rows (at, tie, ...), each followed by the timers of the watermark; and its handle."""
    handle, out, newest = Handle(), [], 0
    processor.init(handle)
    columns = ["at", "tie", *[name for name, _ in processor.columns]]
    for batch in batches:
        if batch:
            list(processor.handleInputRows((1,), iter([pd.DataFrame(batch, columns=columns).assign(key=[key_of(r[1]) for r in batch])]), handle))
            newest = max(newest, max(r[0] for r in batch) // 1_000)
        handle.now = max(handle.now, newest - late_ms)
        while due := sorted(t for t in handle.timers if t <= handle.now):
            handle.fired = due[0]
            for part in processor.handleExpiredTimer((1,), handle, handle):
                out += [(r[0] and int(r[0]), *[ordered._plain(x) for x in r[1:]]) for r in part.astype(object).values.tolist()]
            handle.timers.discard(due[0])
    return out, handle


def in_batches(rows, n, late_s=40):
    """Rows by a time of arrival up to ``late_s`` seconds after their own, in ``n`` batches, and one row that closes all."""
    rng = random.Random(2)
    rows = sorted(rows, key=lambda r: r[0] + rng.random() * late_s * 1e6)
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def some_rows(n, seconds, *choices, seed=4):
    rng = random.Random(seed)
    return [(rng.randrange(seconds * 20) * 50_000, i, *[c(rng) for c in choices]) for i in range(n)]


def slow_rates(rows, span, until):
    for at, tie in sorted(rows):
        window = [t for t, _ in rows if at - span <= t <= at]
        if (at // 1_000_000 + 1) * 1_000 <= until:
            yield 1, tie, len(window), at, min(window)


@pytest.mark.parametrize("page", [1_000, 16, 1])
def test_rates_take_few_calls(monkeypatch, page):
    monkeypatch.setattr(ordered, "PAGE", page, raising=False)
    for n, seconds, batches in ((800, 4_000, 6), (1_500, 60, 12)):
        rows = some_rows(n, seconds)
        got, handle = run(ordered._Rate(20, idle_ms=21_000), in_batches(rows, batches), 60_000)
        assert got == list(slow_rates(rows, 20_000_000, handle.now))
        if page == 1_000:
            assert handle.calls < 20 * batches
        got, handle = run(ordered._Rate(20, idle_ms=21_000), [*in_batches(rows, batches), [(9_000_000_000, n)], []], 60_000)
        assert len(got) == n and len(handle.timers) == 1
        assert not any(getattr(s, "values", None) for s in handle.states[2:])  # forgotten after a rest


def slow_flags(rows, idle, until):
    flag, last = "0", None
    for at, tie, value in sorted(rows, key=lambda r: r[:2]):
        end = (at // 1_000_000 + 1) * 1_000
        if end > until:
            return
        if last is not None and idle and end > last + idle:
            flag = "0"
        last = end
        yield 1, tie, flag == "1"
        flag = value if value in ("0", "1") else flag


@pytest.mark.parametrize("idle", [None, 5_000])
def test_flags_take_few_calls(monkeypatch, idle):
    rows = some_rows(900, 3_000, lambda rng: rng.choice(["0", "1", "1", "2", None]))
    for page in (1_000, 16, 1):
        monkeypatch.setattr(ordered, "PAGE", page, raising=False)
        got, handle = run(ordered._Flag(idle_ms=idle), in_batches(rows, 5), 60_000)
        assert got == list(slow_flags(rows, idle, handle.now)) and len(got) > 800
        if page == 1_000 and not idle:
            assert handle.calls < 75


def slow_log(rows, n, until):
    """(size before, cantons before, whether new, size after, cantons after) of each row by its tie; zeros for a clear."""
    log: list = []
    for at, tie, clear, canton in sorted(rows, key=lambda r: r[:2]):
        if (at // 1_000_000 + 1) * 1_000 > until:
            return
        before = {c for c in log if c}
        log = [] if clear else [*log, canton][-n:]
        yield tie, clear, canton, before, len(log), len({c for c in log if c})


LOGS = (lambda rng: rng.random() < 0.01, lambda rng: rng.choice(["BE", "ZH", "VD", "", None, "TI", "GR"]))


def test_milestones_take_few_calls(monkeypatch):
    rows = some_rows(900, 3_000, *LOGS)
    for page in (1_000, 16, 1):
        monkeypatch.setattr(ordered, "PAGE", page, raising=False)
        got, handle = run(ordered._Milestones(8, 5), in_batches(rows, 5), 60_000)
        want = [(1, tie, "canton", c, len(b) + 1) for tie, clear, c, b, _, _ in slow_log(rows, 8, handle.now) if not clear and c and c not in b]
        assert [r for r in got if r[2] == "canton"] == want and len(want) > 50
        assert {r[2] for r in got} == {"canton", "skin", "complete"}
        assert page < 1_000 or handle.calls < 75


def test_properties_take_few_calls(monkeypatch):
    rows = some_rows(900, 3_000, *LOGS)
    for page in (1_000, 16, 1):
        monkeypatch.setattr(ordered, "PAGE", page, raising=False)
        got, handle = run(ordered._Properties(8), in_batches(rows, 5), 60_000)
        want = [(1, tie, size, cantons) for tie, _, _, _, size, cantons in slow_log(rows, 8, handle.now)]
        assert [r[:4] for r in got] == want and len(want) > 800
        assert page < 1_000 or handle.calls < 75


@pytest.mark.parametrize("make", [lambda: ordered._Rate(20, idle_ms=21_000), lambda: ordered._Flag(idle_ms=5_000), lambda: ordered._Flag(), lambda: ordered._Milestones(8, 5, idle_ms=90_000), lambda: ordered._Properties(8)])
def test_keys_of_a_bucket_do_not_meet(monkeypatch, make):
    choices = {"_Rate": (), "_Flag": (lambda rng: rng.choice(["0", "1", None]),)}.get(type(make()).__name__, LOGS)
    rows, key_of = some_rows(900, 1_500, *choices), lambda tie: (None, "1", "2", "3")[tie * 7919 % 97 % 4]
    for page in (1_000, 16, 2):
        monkeypatch.setattr(ordered, "PAGE", page)
        got, handle = run(make(), in_batches(rows, 7), 60_000, key_of)
        want = []
        for key in (None, "1", "2", "3"):
            alone = [[r for r in batch if key_of(r[1]) == key] for batch in in_batches(rows, 7)]
            part, own = run(make(), alone, 60_000, key_of)
            assert own.now <= handle.now
            want += part
        assert set(want) <= set(got) and len(got) == len(set(got)) and len(got) >= len(want) > 200
