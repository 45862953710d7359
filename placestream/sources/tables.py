"""Readers with explicit schemas: hits, logs, settings, catalogs, snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placestream import constants as C

HIT_SCHEMA = "hit_id long, user_id long, ts_ms long, name string, params string, cookie string, gpc boolean, dnt string, query string, _corrupt_record string"
CATALOG_SCHEMA = "place_id long, name string, lat double, lon double, canton string, kind string"
_LOG = "array<struct<id: string, zyt: bigint, ziuName: string, isPreich: boolean, wurf: struct<art: string, kanton: string, gmeind: string, grund: string, lat: double, lon: double>>>"


def read_hits(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Hits from JSON lines: typed columns, params as VARIANT, unreadable lines in _corrupt_record.

    The same columns come from a stream.
    """
    reader = (spark.readStream if stream else spark.read).schema(HIT_SCHEMA).option("mode", "PERMISSIVE")
    rows = reader.json(path)
    return rows.withColumns({"ts": F.timestamp_millis("ts_ms"), "params_json": F.col("params"), "params": F.try_parse_json("params")})


def read_throw_log(states: DataFrame, json: str = "json", user: str = "user_key") -> DataFrame:
    """Stored logs to one row an entry: user, pos (0 newest), entry_id, ts, is_hit, canton, municipality, place, bullseye.

    Missing, malformed or non-array JSON is an empty log.
    """
    v = F.try_parse_json(json)
    is_list = F.coalesce(F.schema_of_variant(v).like("ARRAY%"), F.lit(False))
    entries = states.filter(is_list).select(user, F.posexplode(F.from_json(json, _LOG)).alias("pos", "e"))
    return entries.select(
        user, "pos", F.col("e.id").alias("entry_id"), F.timestamp_millis("e.zyt").alias("ts"), (F.col("e.wurf.art") == "preich").alias("is_hit"), F.col("e.wurf.kanton").alias("canton"),
        F.col("e.wurf.gmeind").alias("municipality"), F.col("e.ziuName").alias("place"), F.coalesce("e.isPreich", F.lit(False)).alias("bullseye"),
    )


def read_settings(states: DataFrame, json: str = "json", defaults: dict[str, str] = C.DEFAULT_SETTINGS) -> DataFrame:
    """Stored settings over the defaults, a column per setting; malformed JSON gives the defaults."""
    v = F.try_parse_json(json)
    return states.withColumns({k: F.coalesce(F.try_variant_get(v, f"$.{C.STORED_SETTINGS.get(k, k)}", "string"), F.lit(d)) for k, d in defaults.items()})


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The place catalog from Parquet; its columns and types must be those of CATALOG_SCHEMA."""
    rows = spark.read.parquet(path)
    want = [(f.split()[0], f.split()[1].replace("long", "bigint")) for f in CATALOG_SCHEMA.split(", ")]
    have = dict(rows.dtypes)
    wrong = [n for n, t in want if have.get(n) != t]
    if wrong:
        raise ValueError(f"catalog {path}: missing or of another type: {', '.join(wrong)}")
    return rows.select(*[n for n, _ in want])


def read_snapshot(texts: DataFrame, json: str = "json") -> DataFrame:
    """A JSON object of name to metres as rows (name, metres)."""
    return texts.select(F.explode(F.from_json(json, "map<string,int>")).alias("name", "metres"))


def entry_id(user: Column, ts: Column, seq: Column) -> Column:
    """A stable id for entries that came without one."""
    return F.sha2(F.concat_ws("|", user.cast("string"), F.unix_micros(ts).cast("string"), seq.cast("string")).cast("binary"), 256)


def scratch(spark: SparkSession) -> str:
    """A new folder for what a job writes on its way, in the session's shared folder; a local one only in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="placestream-")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
