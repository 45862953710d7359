"""The same work on streams without state of their own, and runs of a stream over a table at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placestream.operators import hits as H
from placestream.operators import points as P
from placestream.sources.tables import scratch


def hit_stream(hits: DataFrame) -> DataFrame:
    """Consent, identity and limits of a stream of hits, without state."""
    return H.tag_dropped(H.derive_client(H.consented_only(H.resolve_consent(hits)), deterministic=True), "event_type", "props")


def resolve_stream(points: DataFrame, candidates: DataFrame, elevations: DataFrame) -> DataFrame:
    """Points of a stream joined with static cell tables."""
    return P.with_elevation(P.resolve_places(points, candidates), elevations)


def once(hits: DataFrame, key: str = "hit_id", watermark: str = "1 hour") -> DataFrame:
    """Each hit once; repeats within the watermark are dropped."""
    return hits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def rate_stream(events: DataFrame, key: str, seconds: int = 60, slide: int = 10, watermark: str = "10 minutes") -> DataFrame:
    """Events a minute in sliding windows, a bounded approximation of the exact rolling rate."""
    window = F.window("ts", f"{seconds} seconds", f"{slide} seconds")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).groupBy(window, key).agg(F.count("*").alias("n")).select(key, F.col("window.end").alias("until"), (F.col("n") * 60.0 / seconds).alias("per_minute"))


def arriving(source: DataFrame, path: str, order: str | None, slices: int) -> Iterator[None]:
    """Write a table as files in ``slices`` parts by time ``order``, one at each step."""
    at = F.unix_micros(F.col(order).cast("timestamp")) if order else F.lit(0)
    low, high = source.agg(F.min(at), F.max(at)).first()
    step = ((high or 0) - (low or 0)) // slices + 1
    for i in range(slices if order else 1):
        part = F.floor((at - (low or 0)) / step)
        rows = source.filter(part.eqNullSafe(F.lit(i)) | (part.isNull() if i == 0 else F.lit(False))) if order else source
        rows.write.mode("append").parquet(path)
        yield


def run_available(source: DataFrame, build: Callable[[DataFrame], DataFrame], mode: str = "append", order: str | None = "ts", slices: int = 3, keys: list[str] | None = None) -> DataFrame:
    """All rows that ``build`` makes of a batch table that arrives as a stream of files.

    The table comes in ``slices`` by time, each a micro-batch of its own of a query that starts
    again from its checkpoint, so that state is carried over batches and restarts. With ``keys`` only
    the last row of each counts, as for a query in update mode.
    """
    spark, path = source.sparkSession, scratch(source.sparkSession)
    out = None

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={epoch}")

    for _ in arriving(source, f"{path}/in", order, slices):
        out = build(spark.readStream.schema(source.schema).parquet(f"{path}/in"))
        writer = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/out")
    if keys:
        rest = [c for c in out.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return rows.drop("batch")
