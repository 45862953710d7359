"""Keyed streams in event-time order: a reorder buffer in state, and the processors of logs, flags and rates on it.

Rows may arrive in any order within the watermark. Keys are dealt over buckets, and each row waits in its bucket's state
until the watermark has passed its slot of event time; a bucket's one timer stands at the end of its earliest slot, and
when it fires all slots that the watermark has passed are put in order and applied. A few rows are kept in one value, so that
a micro-batch costs a bucket a few calls to the state and a key one or two, not some for each row; more go into pages by
time, of which a batch touches those that its rows belong to, and a release those that are due, one after the other. What
a key's processor keeps is an entry of its own. It all lives in RocksDB.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, deque
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from placestream import constants as C

#: Milliseconds of event time whose rows wait together.
SLOT_MS = 1_000
#: Rows that wait in one entry of the state, and times in one of a rate's window; output rows that are given on together.
PAGE = 1_000
#: Groups of keys that share a buffer; fixed, as state is found by them.
BUCKETS = 1_024
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Queries that start from now on keep their state in RocksDB; those with a checkpoint keep what they have."""
    spark.conf.set(_STORE, _ROCKSDB)


class Ordered(StatefulProcessor):
    """Applies each key's rows in order of (at, tie); subclasses say what a key keeps and what its rows give.

    ``columns`` are the rows' (name, type) beside ``at``, the time in microseconds, ``tie``, a long, and ``key``, a
    string. With ``idle_ms`` a key without a row for so long forgets what it keeps.
    """

    columns: tuple[tuple[str, str], ...] = ()
    names: tuple[str, ...] = ()
    #: What a key keeps, as columns.
    kept = ""
    #: Whether rows after a rest find another state than if nothing had been forgotten.
    lapses = True

    def __init__(self, slot_ms: int = SLOT_MS, idle_ms: int | None = None):
        self.slot_ms, self.idle_ms = slot_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = (("at", "long"), ("tie", "long"), ("key", "string"), *self.columns)
        self.fields = [name for name, _ in fields]
        arrays = ", ".join(f"{name} array<{kind}>" for name, kind in fields)
        self.head = handle.getValueState("head", f"wake long, sweep long, pages array<long>, {arrays}")
        self.page = handle.getMapState("page", "low long", arrays)
        self.keys = handle.getMapState("keys", "key string", f"until long, {self.kept}")
        self.open(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        wake, sweep, pages, waiting = self._read()
        for part in rows:
            waiting += zip(*[[_plain(x) for x in part[name].tolist()] for name in self.fields], strict=True)
            if len(waiting) > PAGE:
                waiting = self._file(pages, waiting)
        self._write(wake, sweep, pages, waiting)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        wake, sweep, pages, waiting = self._read()
        if wake != expiredTimerInfo.getExpiryTimeInMs():
            return
        now, out, found = timerValues.getCurrentWatermarkInMs(), [], {}
        bound = now // self.slot_ms * self.slot_ms * 1_000
        if waiting and pages and pages[0] < bound:
            waiting = self._file(pages, waiting)
        due = [r for r in waiting if r[0] < bound]
        waiting = [r for r in waiting if r[0] >= bound] if due else waiting
        for held in [sorted(due, key=_order)] if due else self._due(pages, bound):
            for one, own in self._by_key(held):
                self._apply(one, own, found, out)
            if len(out) >= PAGE:
                yield pd.DataFrame(out, columns=list(self.names))
                out = []
            if len(found) > PAGE:
                sweep, found = self._keep(found, None, sweep), {}
        sweep = self._keep(found, now, sweep)
        if sweep is not None and sweep <= now:
            sweep = self._forget(now)
        self._write(None, sweep, pages, waiting)
        if out:
            yield pd.DataFrame(out, columns=list(self.names))

    @staticmethod
    def _by_key(rows: list[tuple]) -> Iterator[tuple[Any, list[tuple]]]:
        """Each key's rows, without the key, in the order they have."""
        own: dict = {}
        for at, tie, key, *more in rows:
            own.setdefault(key, []).append((at, tie, *more))
        yield from own.items()

    def _apply(self, key: Any, rows: list[tuple], found: dict, out: list[tuple]) -> None:
        """Apply a key's rows to what it keeps, which ``found`` holds during a release with what the state has and when it is forgotten."""
        if key not in found:
            stored = self.keys.getValue((key,))
            stored = tuple(stored) if stored else None
            found[key] = (stored, *((stored[0], stored[1:]) if stored else (None, None)))
        stored, until, kept = found[key]
        for run, rested, until in self._runs(rows, until):
            if rested and kept is not None:
                self.drop(key, kept)
                kept = None
            kept = self.apply(key, kept, run, out)
        found[key] = (stored, until, kept)

    def _keep(self, found: dict, now: int | None, sweep: int | None) -> int | None:
        """Write what keys keep, and give the time at which to look for keys at rest; amid a release (no ``now``) more of their rows may come."""
        for key, (stored, until, kept) in found.items():
            if kept is not None and until is not None and now is not None and until <= now:
                self.drop(key, kept)
                kept = None
            if kept is None:
                if stored is not None:
                    self.keys.removeKey((key,))
            else:
                if (until, *kept) != stored:
                    self.keys.updateValue((key,), (until, *kept))
                sweep = until if sweep is None else sweep
        return sweep

    def _forget(self, now: int) -> int | None:
        """Forget the keys at rest; gives when to look again, no sooner than half the time of rest from now."""
        rest, gone = None, []
        for (key,), (until, *kept) in self.keys.iterator():
            if until <= now:
                gone.append((key, tuple(kept)))
            else:
                rest = until if rest is None else min(rest, until)
        for key, kept in gone:
            self.drop(key, kept)
            self.keys.removeKey((key,))
        return None if rest is None else max(rest, now + int(self.idle_ms) // 2)

    def _read(self) -> tuple[int | None, int | None, list[int], list[tuple]]:
        """The time of the bucket's timer, that at which to look for keys at rest, the least times of its pages, and the rows in no page."""
        wake, sweep, pages, *columns = self.head.get() or (None, None, [], *[[] for _ in self.fields])
        return wake, sweep, list(pages), list(zip(*columns, strict=True))

    def _write(self, wake: int | None, sweep: int | None, pages: list[int], waiting: list[tuple]) -> None:
        """Write that back, with a timer (``wake`` is set already) at the first time at which there is something to do."""
        earliest = min([*pages[:1], *[r[0] for r in waiting]], default=None)
        first = min([t for t in (sweep, None if earliest is None else self._end(earliest)) if t is not None], default=None)
        if first != wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            if first is not None:
                self.handle.registerTimer(first)
        if first is None:
            self.head.clear()
        else:
            self.head.update((first, sweep, pages, *self._columns(waiting)))

    def _end(self, at: int) -> int:
        """The end of a time's slot."""
        return (at // (1_000 * self.slot_ms) + 1) * self.slot_ms

    def _columns(self, rows: list[tuple]) -> tuple[list, ...]:
        return tuple([r[i] for r in rows] for i in range(len(self.fields)))

    def _file(self, pages: list[int], rows: list[tuple]) -> list[tuple]:
        """Put rows into the pages of their times, which are cut if they grow too long; none is left.

        A page goes by its least time, and rows of the same time are in one page.
        """
        rows = sorted(rows, key=_order)
        if not pages or rows[0][0] < pages[0]:
            pages.insert(0, rows[0][0])
        for low, new in [(low, list(part)) for low, part in groupby(rows, key=lambda r: pages[bisect_right(pages, r[0]) - 1])]:
            old = self.page.getValue((low,))
            held = sorted([*zip(*old, strict=True), *new], key=_order) if old else new
            while held:
                end = PAGE // 2 if len(held) > PAGE else len(held)
                end = bisect_right(held, held[end - 1][0], key=lambda r: r[0])
                if held[0][0] != low:
                    insort(pages, held[0][0])
                self.page.updateValue((held[0][0],), self._columns(held[:end]))
                held = held[end:]
        return []

    def _due(self, pages: list[int], bound: int) -> Iterator[list[tuple]]:
        """The rows before ``bound`` in order, page by page, which are taken out."""
        while pages and pages[0] < bound:
            low = pages.pop(0)
            held = sorted(zip(*self.page.getValue((low,)), strict=True), key=_order)
            self.page.removeKey((low,))
            end = bisect_left(held, bound, key=lambda r: r[0])
            if end < len(held):
                pages.insert(0, held[end][0])
                self.page.updateValue((held[end][0],), self._columns(held[end:]))
            yield held[:end]

    def _runs(self, rows: list[tuple], until: int | None) -> Iterator[tuple[list[tuple], bool, int | None]]:
        """Rows between which the key does not rest, whether it did before them, and when it is forgotten after them."""
        if self.idle_ms is None:
            yield rows, False, None
            return
        begin, rested = 0, False
        for i, row in enumerate(rows):
            end = self._end(row[0])
            if until is not None and end > until and self.lapses:
                if i > begin:
                    yield rows[begin:i], rested, until
                begin, rested = i, True
            until = end + int(self.idle_ms)
            until += until % self.slot_ms == 0  # never a slot's end, at which the key would have to be forgotten before or after it
        yield rows[begin:], rested, until

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Set up state beside what keys keep."""

    def drop(self, key: Any, kept: tuple) -> None:
        """Clear a key's part of it."""

    def apply(self, key: Any, kept: tuple | None, rows: list[tuple], out: list[tuple]) -> tuple | None:
        """Put output rows of a key's (at, tie, *columns), which are in order, to ``out``; gives what the key keeps then."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _order(row: tuple) -> tuple:
    return row[:2]


def _plain(x: Any) -> Any:
    """A value of a column as state holds it: missing ones as none."""
    return None if x is None or x != x else x


class _Log(Ordered):
    """The last ``n`` entries' cantons since the last clear, oldest first; empty ones have none."""

    columns = (("is_clear", "boolean"), ("canton", "string"))
    kept = "cantons array<string>"

    def __init__(self, n: int, **more: Any):
        super().__init__(**more)
        self.n = n

    def apply(self, key: Any, kept: tuple | None, rows: list[tuple], out: list[tuple]) -> tuple | None:
        log = deque(*(kept or ([],)))
        often = Counter(c for c in log if c)
        for at, tie, is_clear, canton in rows:
            if is_clear:
                log.clear()
                often.clear()
                out += self.cleared(key, at, tie)
                continue
            canton, size, cantons = canton or "", len(log), len(often)
            had = canton in often
            if size == self.n and (old := log.popleft()):
                often[old] -= 1
                if not often[old]:
                    del often[old]
            log.append(canton)
            if canton:
                often[canton] += 1
            out += self.entered(key, at, tie, canton, had, size, cantons, len(often))
        return (list(log),) if log else None

    def cleared(self, key: Any, at: int, tie: int) -> Iterator[tuple]:
        return iter(())

    def entered(self, key: Any, at: int, tie: int, canton: str, had: bool, size: int, cantons: int, after: int) -> Iterator[tuple]:
        raise NotImplementedError


class _Milestones(_Log):
    names = ("user_key", "event_id", "kind", "value", "count")

    def __init__(self, n: int, total: int, **more: Any):
        super().__init__(n, **more)
        self.total = total

    def entered(self, key: Any, at: int, tie: int, canton: str, had: bool, size: int, cantons: int, after: int) -> Iterator[tuple]:
        if canton and not had:
            yield key, tie, "canton", canton, cantons + 1
            if cantons + 1 == self.total:
                yield key, tie, "complete", "all", size + 1
        for skin, threshold in C.SKINS:
            if threshold and threshold == size + 1:
                yield key, tie, "skin", skin, threshold


class _Properties(_Log):
    names = ("user_key", "event_id", "throw_count", "cantons_collected", "dart_skins_unlocked")

    def _row(self, key: Any, tie: int, size: int, cantons: int) -> tuple:
        return key, tie, size, cantons, sum(size >= t for _, t in C.SKINS)

    def cleared(self, key: Any, at: int, tie: int) -> Iterator[tuple]:
        yield self._row(key, tie, 0, 0)

    def entered(self, key: Any, at: int, tie: int, canton: str, had: bool, size: int, cantons: int, after: int) -> Iterator[tuple]:
        yield self._row(key, tie, min(size + 1, self.n), after)


class _Flag(Ordered):
    columns = (("value", "string"),)
    names = ("user_id", "hit_id", "internal")
    kept = "flag string"

    def apply(self, key: Any, kept: tuple | None, rows: list[tuple], out: list[tuple]) -> tuple | None:
        flag = kept[0] if kept else "0"
        for _, tie, value in rows:
            out.append((key, tie, flag == "1"))
            flag = value if value in ("0", "1") else flag
        return (flag,) if flag == "1" else None


class _Rate(Ordered):
    """A queue of event times: the newest in the value, older ones in chunks from ``first`` to before ``end``, and how many of the oldest have left."""

    names = ("key", "event_id", "n", "at", "first")
    kept = "first long, end long, gone int, n long, newest array<long>"
    lapses = False

    def __init__(self, seconds: int, **more: Any):
        super().__init__(**more)
        self.span = seconds * 1_000_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getMapState("times", "key string, chunk long", "at array<long>")

    def drop(self, key: Any, kept: tuple) -> None:
        for chunk in range(kept[0], kept[1]):
            self.times.removeKey((key, chunk))

    def apply(self, key: Any, kept: tuple | None, rows: list[tuple], out: list[tuple]) -> tuple | None:
        first, end, gone, n, newest = kept or (0, 0, 0, 0, [])
        newest = list(newest)
        oldest = newest if first == end else self.times.getValue((key, first))[0]
        same, before = Counter(r[0] for r in rows), None
        for at, tie in rows:
            if at != before:  # those of the same time come in together
                newest.extend([at] * same[at])
                n, before = n + same[at], at
            while oldest[gone] < at - self.span:
                gone, n = gone + 1, n - 1
                if gone == len(oldest) and oldest is not newest:
                    self.times.removeKey((key, first))
                    first, gone = first + 1, 0
                    oldest = newest if first == end else self.times.getValue((key, first))[0]
            out.append((key, tie, n, at, oldest[gone]))
        if oldest is newest:
            newest, gone = newest[gone:], 0
        while len(newest) > PAGE:
            self.times.updateValue((key, end), (newest[:PAGE],))
            end, newest = end + 1, newest[PAGE:]
        return first, end, gone, n, newest


def _prepared(rows: DataFrame, key: str, tie: str, watermark: str, **columns: Column) -> DataFrame:
    """(key, ts, at, tie, ...) with a watermark; rows without a time or key order are left out."""
    use_rocksdb(rows.sparkSession)
    ts = F.col("ts").cast("timestamp")
    named = rows.select(F.col(key).alias(key), ts.alias("ts"), F.unix_micros(ts).alias("at"), F.col(tie).cast("long").alias("tie"), *[c.alias(n) for n, c in columns.items()])
    return named.filter(F.col("at").isNotNull() & F.col("tie").isNotNull()).withWatermark("ts", watermark)


def _run(rows: DataFrame, key: str, processor: Ordered, schema: str) -> DataFrame:
    """``processor`` on rows by buckets of their keys; a key goes as text and comes back as the type it has in ``schema``."""
    fields = T.StructType.fromDDL(schema)
    out = T.StructType([T.StructField(fields[0].name, T.StringType()), *fields.fields[1:]])
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    keyed = rows.select(bucket.alias("bucket"), "ts", "at", "tie", F.col(key).cast("string").alias("key"), *[name for name, _ in processor.columns])
    done = keyed.groupBy("bucket").transformWithStateInPandas(processor, out, "append", "eventTime")
    return done.withColumn(fields[0].name, F.col(fields[0].name).cast(fields[0].dataType))


def _entries(log: DataFrame, watermark: str) -> DataFrame:
    canton = F.when(F.col("is_hit"), F.col("canton").cast("string"))
    return _prepared(log, "user_key", "event_id", watermark, is_clear=F.coalesce("is_clear", F.lit(False)), canton=canton)


def milestone_stream(log: DataFrame, n: int = C.LOG_SIZE, total: int = len(C.CANTONS), watermark: str = "10 minutes", slot_ms: int = SLOT_MS, idle_ms: int | None = None) -> DataFrame:
    """Milestones of throws (user_key, event_id, ts, is_clear, is_hit, canton) that arrive within the watermark in any order.

    (user_key, event_id, kind, value, count); kinds are canton, complete and skin. A throw's milestones
    come once the watermark has passed its slot of ``slot_ms``; rows later than the watermark are dropped.
    """
    return _run(_entries(log, watermark), "user_key", _Milestones(n, total, slot_ms=slot_ms, idle_ms=idle_ms), "user_key long, event_id long, kind string, value string, count long")


def user_properties_stream(log: DataFrame, n: int = C.LOG_SIZE, watermark: str = "10 minutes", slot_ms: int = SLOT_MS, idle_ms: int | None = None) -> DataFrame:
    """(user_key, event_id, throw_count, cantons_collected, dart_skins_unlocked) after every change of a log, clears included."""
    return _run(_entries(log, watermark), "user_key", _Properties(n, slot_ms=slot_ms, idle_ms=idle_ms), "user_key long, event_id long, throw_count long, cantons_collected long, dart_skins_unlocked long")


def internal_flag_stream(hits: DataFrame, watermark: str = "10 minutes", slot_ms: int = SLOT_MS, idle_ms: int | None = None) -> DataFrame:
    """(user_id, hit_id, internal): the device's flag before each hit (user_id, hit_id, ts, internal_value)."""
    rows = _prepared(hits, "user_id", "hit_id", watermark, value=F.col("internal_value"))
    return _run(rows, "user_id", _Flag(slot_ms=slot_ms, idle_ms=idle_ms), "user_id long, hit_id long, internal boolean")


def exact_rate_stream(events: DataFrame, key: str, seconds: int = 60, per_word: float = 5.0, min_span: float | None = None, watermark: str = "10 minutes", slot_ms: int = SLOT_MS) -> DataFrame:
    """(key, event_id, n, rate) of each event (key, event_id, ts): ``telemetry.rolling_rate`` on a stream, row by row.

    A key's state is the times of its last ``seconds``, which leave as events come in; keys that rest so
    long are forgotten.
    """
    rows = _prepared(events, key, "event_id", watermark).withColumnRenamed(key, "key")
    kind = rows.schema["key"].dataType.simpleString()
    out = _run(rows, "key", _Rate(seconds, slot_ms=slot_ms, idle_ms=1_000 * seconds + slot_ms), f"key {kind}, event_id long, n long, at long, first long")
    span = (F.col("at") - F.col("first")) / 1e6
    used = F.greatest(span, F.lit(float(min_span))) if min_span else span
    return out.select(F.col("key").alias(key), "event_id", "n", F.when((F.col("n") >= 2) & (span > 0), F.col("n") / used * 60 / per_word).alias("rate"))
