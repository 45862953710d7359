"""Tables that micro-batches upsert: hash buckets of parts, merged as they are read and now and then rewritten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placestream import constants as C
from placestream.operators.points import distinct_cells
from placestream.operators.telemetry import merge_counters

BUCKETS = 64
#: Parts of a bucket beyond which a batch that touches it makes them one.
MOST_PARTS = 8
_BUCKET = "_bucket"


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    place, fs = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []


def _delete(spark: SparkSession, path: str) -> None:
    place, fs = _fs(spark, path)
    fs.delete(place, True)


class BucketTable:
    """Rows below ``path`` in ``buckets`` by a hash of ``keys``; ``merge`` makes one of the rows of a key.

    Batch e writes its own rows, merged by key, as one part of each bucket it touches, so what is written
    follows the batch and not the table. A bucket with more than ``most_parts`` parts is made one part by
    the batch that touches it next. A manifest a batch lists the parts of every bucket; it is written
    last, so readers see a batch whole or not at all, and a batch that is replayed makes the same
    manifest again from the one before it. Parts that no manifest of the last two batches lists are
    deleted. ``keys`` may hold nulls. A table and the checkpoint of its stream belong together.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS, most_parts: int = MOST_PARTS):
        self.spark, self.path, self.keys, self.merge, self.buckets, self.most_parts = spark, path, keys, merge, buckets, most_parts

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def manifest(self, epoch: int) -> dict[int, list[int]]:
        """The parts (batch numbers) of every bucket after a batch; at most ``buckets`` rows."""
        if epoch < 0:
            return {}
        rows = self.spark.read.schema("bucket int, parts array<long>").parquet(f"{self.path}/manifests/e{epoch}").collect()
        return {r["bucket"]: list(r["parts"]) for r in rows}

    def newest(self) -> int:
        """The last batch with a whole manifest; -1 without any."""
        place = f"{self.path}/manifests"
        return max((int(n[1:]) for n in _names(self.spark, place) if "_SUCCESS" in _names(self.spark, f"{place}/{n}")), default=-1)

    def _rows(self, parts: dict[int, list[int]]) -> DataFrame | None:
        paths = [f"{self.path}/parts/e{e}/{_BUCKET}={b}" for b, epochs in parts.items() for e in epochs]
        return self.spark.read.parquet(*paths) if paths else None

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        """Merge a batch's rows into the table as its batch ``epoch``, numbered from 0 without gaps."""
        new = self.merge(batch).withColumn(_BUCKET, self._bucket()).persist()
        try:
            before = self.manifest(epoch - 1)
            touched = [r[0] for r in new.select(_BUCKET).distinct().collect()]
            full = {b: before[b] for b in touched if len(before.get(b, [])) > self.most_parts}
            rows = new
            if full:
                mine = F.col(_BUCKET).isin(list(full))
                whole = self.merge(self._rows(full).unionByName(new.filter(mine).drop(_BUCKET))).withColumn(_BUCKET, self._bucket())
                rows = new.filter(~mine).unionByName(whole)
            rows.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/parts/e{epoch}")
            after = before | {b: [epoch] if b in full else [*before.get(b, []), epoch] for b in touched}
            listed = self.spark.createDataFrame(list(after.items()), "bucket int, parts array<long>")
            listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/e{epoch}")
            self._clean(epoch, before, after)
        finally:
            new.unpersist()

    def _clean(self, epoch: int, before: dict[int, list[int]], after: dict[int, list[int]]) -> None:
        if epoch < 2 or f"e{epoch - 2}" not in _names(self.spark, f"{self.path}/manifests"):
            return
        for b, parts in self.manifest(epoch - 2).items():
            for e in set(parts) - set(before.get(b, [])) - set(after.get(b, [])):
                _delete(self.spark, f"{self.path}/parts/e{e}/{_BUCKET}={b}")
        _delete(self.spark, f"{self.path}/manifests/e{epoch - 2}")

    def read(self) -> DataFrame | None:
        """The merged rows after the newest whole batch; none before the first."""
        rows = self._rows(self.manifest(self.newest()))
        return None if rows is None else self.merge(rows)

    def read_touched(self, rows: DataFrame, epoch: int) -> DataFrame | None:
        """The merged rows of the buckets in which ``rows`` has keys, as they were after batch ``epoch``."""
        touched = {r[0] for r in rows.select(self._bucket()).distinct().collect()}
        found = self._rows({b: parts for b, parts in self.manifest(epoch).items() if b in touched})
        return None if found is None else self.merge(found)


def counter_table(spark: SparkSession, path: str, keys: list[str], **more: int) -> BucketTable:
    """A table of counters (keys, n, first_ts, mean, peak, seq) that add up by ``telemetry.merge_counters``."""
    return BucketTable(spark, path, keys, lambda rows: merge_counters(rows.limit(0), rows, keys), **more)


def counter_stream(rows: DataFrame, table: BucketTable, checkpoint: str, interval: str = "30 seconds"):
    """Upsert micro-batches of partial counters into a table. Returns the query's writer; call ``start()`` or change the trigger first."""
    return rows.writeStream.foreachBatch(lambda batch, epoch: table.upsert(batch, epoch)).option("checkpointLocation", checkpoint).trigger(processingTime=interval)


def cell_table(spark: SparkSession, path: str, **more: int) -> BucketTable:
    """A table of looked-up cells (s_lat, s_lon, fetched_at, ...), the newest answer of each."""
    keys = ["s_lat", "s_lon"]

    def newest(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        best = F.max_by(F.struct(*rest), "fetched_at").alias("_r")
        return rows.groupBy(*keys).agg(best).select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])

    return BucketTable(spark, path, keys, newest, **more)


def look_up(points: DataFrame, table: BucketTable, answer: Callable[[DataFrame], DataFrame], epoch: int, days: int = C.CELL_DAYS) -> None:
    """Look up the cells of a batch of ``points`` (lat, lon, ts) that the table has no answer of the last ``days`` for.

    ``answer`` gives the answers to cells (s_lat, s_lon), one row each; they are kept with the batch's
    latest time as ``fetched_at``. Only buckets with cells of the batch are read. A batch that is
    replayed looks at the table as it was before, and so asks for the same cells.
    """
    now = points.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    if now is None:
        table.upsert(table.spark.createDataFrame([], answer(distinct_cells(points)).withColumn("fetched_at", F.current_timestamp()).schema), epoch)
        return
    cells = distinct_cells(points).persist()
    try:
        known = table.read_touched(cells, epoch - 1)
        at = F.lit(now).cast("timestamp")
        wanted = cells if known is None else cells.join(known.filter(F.col("fetched_at") >= at - F.expr(f"interval {days} days")), ["s_lat", "s_lon"], "left_anti")
        table.upsert(answer(wanted).withColumn("fetched_at", at), epoch)
    finally:
        cells.unpersist()


def lookup_stream(points: DataFrame, table: BucketTable, answer: Callable[[DataFrame], DataFrame], checkpoint: str, days: int = C.CELL_DAYS):
    """Keep a table of cells up to date with a stream of points. Returns the query's writer; call ``start()`` or add a trigger first."""
    return points.writeStream.foreachBatch(lambda batch, epoch: look_up(batch, table, answer, epoch, days)).option("checkpointLocation", checkpoint)
