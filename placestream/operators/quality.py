"""Catalog checks: elevations against a snapshot, cantons, word pages; snapshots are written whole or not."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placestream import constants as C
from placestream.functions.geo import in_bbox


def verify_catalog(catalog: DataFrame, resolved: DataFrame, snapshot: DataFrame, tolerance_m: int = C.ELEVATION_TOLERANCE_M) -> DataFrame:
    """(name, status, note) of every catalog place and stale snapshot row.

    ``catalog`` (name, lat, lon, canton, kind), ``resolved`` (name, outcome, canton, elevation,
    water; outcome 'error' for failed lookups), ``snapshot`` (name, metres). Hard failures come
    first, in order: outside the box, miss, no elevation; then new, drift; ``stale`` is in the
    snapshot alone. Good rows may carry notes: canton differs, settlement in water.
    """
    r = resolved.select("name", "outcome", F.col("canton").alias("r_canton"), "elevation", "water")
    rows = catalog.join(r, "name", "left").join(snapshot.withColumn("saved", F.lit(True)), "name", "full_outer")
    known = F.col("lat").isNotNull()
    status = (
        F.when(~known, "stale").when(~in_bbox("lat", "lon"), "outside").when(F.coalesce(F.col("outcome") == "error", F.lit(True)), "error")
        .when(F.col("outcome") != "hit", "miss").when(F.col("elevation").isNull(), "no_elevation").when(F.col("saved").isNull(), "new")
        .when(F.abs(F.col("elevation") - F.col("metres")) > tolerance_m, "drift").otherwise("ok")
    )
    canton = F.when(~F.contains(F.coalesce("r_canton", F.lit("")), F.col("canton")), "canton")
    water = F.when(F.col("kind").isin(*C.SETTLEMENTS) & F.col("water"), "in_water")
    return rows.withColumn("status", status).select("name", "status", F.when(F.col("status") == "ok", F.nullif(F.concat_ws(",", canton, water), F.lit(""))).alias("note"))


def verification_summary(verified: DataFrame) -> DataFrame:
    """(catalog, failed, passed, to_look_at): stale rows count as failed although they are no catalog
    rows, so passed = catalog - failed can undercount."""
    n = verified.agg(F.count_if(F.col("status") != "stale").alias("catalog"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if(F.col("note").isNotNull()).alias("to_look_at"))
    return n.select("catalog", "failed", (F.col("catalog") - F.col("failed")).alias("passed"), "to_look_at")


def missing_words(words: DataFrame, hits: DataFrame) -> DataFrame:
    """Words (word) without a hit; ``hits`` has (word, n) of the pages that loaded."""
    return words.join(hits, "word", "left").filter(F.coalesce(F.col("n"), F.lit(0)) == 0).select("word")


def vocab_summary(hits: DataFrame) -> DataFrame:
    """(found, total): a page that did not load counts as found."""
    return hits.agg(F.count_if(F.col("n").isNull() | (F.col("n") > 0)).alias("found"), F.count("*").alias("total"))


def write_snapshot(verified: DataFrame, elevations: DataFrame, path: str, locale: str = "de") -> int:
    """Write (name, metres) sorted by name in the locale's order, unless any place failed hard; returns that number.

    All or nothing: with a failure the folder is left as it is, and a new snapshot takes its place
    only when it is complete.
    """
    hard = verified.filter(F.col("status").isin("outside", "miss", "no_elevation", "error")).count()
    if hard == 0:
        spark = elevations.sparkSession
        fresh, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
        elevations.select("name", "metres").orderBy(F.collate("name", locale)).write.parquet(fresh)
        fresh, old, now = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, old, path))
        _swap(now.getFileSystem(spark._jsc.hadoopConfiguration()), fresh, now, old)
    return hard


def _swap(files, fresh, now, old) -> None:
    """Put a complete folder in the place of another; if that fails the other stays, or is put back."""
    had = files.exists(now)
    moved = not had or files.rename(now, old)
    if moved and files.rename(fresh, now):
        if had:
            files.delete(old, True)
        return
    back = not had or not moved or files.rename(old, now)
    files.delete(fresh, True)
    raise OSError(f"the snapshot at {now} cannot be replaced" + ("" if back else f"; what it held is in {old}"))
