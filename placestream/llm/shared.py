"""Session helpers: shared folders, seeds and folds used by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that a hot group is split into before it is joined or its least member is sought.
SALTS = 256


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor of a cluster can reach.

    Where the setting is absent, a temporary folder of this machine becomes the checkpoint folder of
    a local session (as in tests); a session on a cluster gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if current is None:
            current = "file://" + tempfile.mkdtemp(prefix="placestream-")
        base = current
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, without its lineage."""
    shared_dir(df.sparkSession, "unused")
    return df.checkpoint(eager=True)


def join_hot(left: DataFrame, right: DataFrame, key: str, rest: list[str], salts: int = SALTS) -> DataFrame:
    """Inner join of ``left`` (key, *rest) with ``right``, unique by key, where a key may be hot.

    The rows of a key are first gathered into at most ``salts`` lists in as many tasks, so that at
    most so many rows of a key meet in the join; then they are spread out again.
    """
    salt = F.pmod(F.xxhash64(*rest), F.lit(salts)).alias("_salt")
    lists = left.select(key, *rest, salt).groupBy(key, "_salt").agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    joined = lists.join(right, key).withColumn("_row", F.explode("_rows"))
    return joined.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest], *[c for c in right.columns if c != key])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; null ids fall in the fold of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
