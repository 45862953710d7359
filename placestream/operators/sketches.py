"""Reports over any range of days from sketches kept a day: quantiles of values, and distinct users with their overlaps.

A day's rows are read once. Its sketches are small, add up to those of any range and any coarser group,
and are kept in a table with a partition a day, in which a day that comes again replaces itself.
The exact reports are ``reports.quantile`` and ``reports.traffic_report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accuracy of quantiles: groups of up to so many values are exact, the ranks of others are right to about 1.3 / ACCURACY**0.9.
ACCURACY = 4096
#: Binary logarithm of the users a sketch of users keeps: up to so many are counted exactly, more to about 1 in 128 (two standard errors).
USERS_LG = 16


def daily_values(rows: DataFrame, by: list[str], value: str, ts: str = "ts", accuracy: int = ACCURACY) -> DataFrame:
    """(date, *by, n, sketch) of the values of each day and group; null values do not count."""
    known = rows.filter(F.col(value).isNotNull())
    return known.groupBy(F.to_date(ts).alias("date"), *by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), accuracy).alias("sketch"))


def daily_users(rows: DataFrame, by: list[str], user: str = "user_id", ts: str = "ts", lg: int = USERS_LG) -> DataFrame:
    """(date, *by, n, sketch) of the rows and users of each day and group; null users do not count as one."""
    return rows.groupBy(F.to_date(ts).alias("date"), *by).agg(F.count("*").alias("n"), F.theta_sketch_agg(user, lg).alias("sketch"))


def keep_days(days: DataFrame, path: str) -> None:
    """Put the days of ``days`` into the table at ``path``, replacing those it has of the same dates and no others."""
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def kept_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def between(days: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The days from ``first`` to ``last``, both included; only their partitions are read."""
    if first is not None:
        days = days.filter(F.col("date") >= F.lit(first).cast("date"))
    return days if last is None else days.filter(F.col("date") <= F.lit(last).cast("date"))


def quantiles(days: DataFrame, by: list[str], ranks: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """(*by, n, a column a rank): the least value that at least such a share of a group's values do not exceed."""
    whole = days.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", accuracy).alias("_s"))
    return whole.select(*by, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(float(q))).alias(name) for name, q in ranks.items()])


def users(days: DataFrame, by: list[str], lg: int = USERS_LG) -> DataFrame:
    """(*by, n, users): rows and distinct users of each group."""
    return days.groupBy(*by).agg(F.sum("n").alias("n"), F.theta_sketch_estimate(F.theta_union_agg("sketch", lg)).alias("users"))


def common_users(days: DataFrame, by: list[str], one: Column, other: Column, lg: int = USERS_LG) -> DataFrame:
    """(*by, one, other, both): users with a row for which ``one`` holds, with one for which ``other`` does, and with both.

    The conditions are over the columns of ``days``: its dates, or dimensions that are not in ``by``.
    """
    part = lambda c: F.theta_union_agg(F.when(c, F.col("sketch")), lg)
    both = days.groupBy(*by).agg(part(one).alias("_a"), part(other).alias("_b"))
    size = F.theta_sketch_estimate
    return both.select(*by, size("_a").alias("one"), size("_b").alias("other"), size(F.theta_intersection("_a", "_b")).alias("both"))
