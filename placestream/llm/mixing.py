"""Operator 8: mix sources to target weights by repetition rates (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST_REPEATS = 3
#: Sources whose rates are broadcast; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) to targets that share the whole by weight under a cap per source.

    Each target is min(cap, level x weight); the level is found in one ordered pass, because a
    source is capped before every source with a higher cap per unit of weight. One row a source.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int"))
    capped = ranked.withColumns({"_w": weight.cast("long"), "_cap": F.col("source_size") * most})
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by_ratio), F.lit(0))
    )
    levelled = capped.withColumn("_level", level)
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))
    lowest = levelled.withColumn("_level", F.coalesce(F.max(fits).over(everything), F.lit(0.0)))
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w"))
    return lowest.select("source", "source_size", target.alias("target"))


def unit_draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of md5(seed:key)."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def copies_for_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``docs`` with _size, _source_size, _target and _copies: how often the mix takes each row.

    The rate of a source is target over size; a row is taken floor(rate) times and once more when
    its draw, seeded by its id, is below the fraction. No shuffle of documents: a first pass sums
    words per source (one row a source is kept), a second joins the rates.

    Null source: a source of its own, last in order. Null or empty text: size 0; it is taken like
    the others and adds no words. Rows that repeat an id share its draw; a null id draws as ''.
    Empty table: no rows. Extra columns stay; names beginning with an underscore are reserved.
    """
    sized = docs.withColumn("_size", word_count(F.col(text_col)))
    totals = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("_size").alias("source_size"))
    totals = cut(totals)
    targets = source_targets(totals, weights, most)
    rates = cut(
        targets.select(
            F.col("source").alias("_source"),
            F.col("source_size").alias("_source_size"),
            F.col("target").alias("_target"),
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"),
        )
    )
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = sized.join(rates, F.col(source_col).eqNullSafe(F.col("_source")), "inner").drop("_source")
    whole = F.floor("_rate")
    extra = (unit_draw(F.col(id_col), seed) < F.col("_rate") - whole).cast("int")
    return joined.withColumn("_copies", (whole + extra).cast("int")).drop("_rate")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, in its own columns."""
    counted = copies_for_mix(docs, **options)
    repeated = counted.withColumn("_copy", F.explode(F.expr("array_repeat(0, _copies)")))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return copies_for_mix(docs).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


OP8_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as w,
    source_size * 3 as cap, row_number() over (order by source nulls last) as n from totals),
levels as (
  select *, ((sum(source_size) over () - coalesce(sum(cap) over before, 0))::bigint)::double
    / ((sum(w) over () - coalesce(sum(w) over before, 0))::bigint)::double as level
  from ranked window before as (order by cap::double / w::double, n rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, least(cap::double, coalesce(max(case when level <= cap::double / w::double then level end) over (), 0) * w) as target from levels),
rates as (select *, case when source_size > 0 then target / source_size else 0 end as rate from targets)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0
    < rate - floor(rate) then 1 else 0 end))::bigint as taken
from sized join rates on sized.source is not distinct from rates.source
"""
