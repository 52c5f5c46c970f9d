"""Statistics: distributions, totals, rates and per-bin moments of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges into which values are dealt in one round.
RANGES = 128
#: Distinct values that one task may order.
TASK_ROWS = 1_000_000


def _with(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` beside the rows of ``right`` of equal keys, nulls included; keys once."""
    other = right.select([F.col(c).alias(f"_o_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return left.join(other, cond, how).drop(*[f"_o_{k}" for k in keys])


def _counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))


def _ranked(rows: DataFrame, keys: list[str], points: dict[str, float], rounds: int) -> DataFrame:
    """``percentiles`` of distinct values ``_v`` with their counts ``_c``."""
    sums = rows.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranks = []
    for name, share in points.items():
        at = F.lit(share) * (F.col("_n") - 1)
        low = F.floor(at)
        ranks += [F.struct(F.lit(name).alias("name"), (low + k).alias("rank"), (w(at - low)).alias("weight")) for k, w in ((0, lambda f: 1 - f), (1, lambda f: f))]
    wanted = sums.select(*keys, F.explode(F.array(*ranks)).alias("_w")).filter("_w.weight > 0")
    few, group = rows.withColumns({"_before": F.lit(0).cast("bigint"), "_b": F.lit("")}), [*keys, "_b"]
    wanted = wanted.withColumn("_b", F.lit(""))
    for _ in range(rounds):  # values are dealt into ranges, and the ranges that hold a wanted rank go on
        cuts = few.groupBy(*group).agg(F.percentile_approx("_v", [k / RANGES for k in range(1, RANGES)], 10_000).alias("_cuts"))
        placed = _with(few, cuts, group).withColumn("_r", F.concat_ws("/", "_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).cast("string"))).drop("_cuts")
        held = placed.groupBy(*group, "_r", "_before").agg(F.sum("_c").alias("_m"), F.min("_v").alias("_low"))
        before = F.col("_before") + F.sum("_m").over(Window.partitionBy(*group).orderBy("_low").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")
        held = _with(held.withColumn("_before", before), wanted, group).filter("_w.rank >= _before and _w.rank < _before + _m")
        few = _with(placed.drop("_before", "_b").withColumnRenamed("_r", "_b"), held.select(*keys, F.col("_r").alias("_b"), "_before").distinct(), group)
        wanted = held.select(*keys, F.col("_r").alias("_b"), "_w")
    inside = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("_end", F.col("_before") + F.sum("_c").over(inside)).drop("_before")
    found = _with(few, wanted, group).filter("_w.rank >= _end - _c and _w.rank < _end")
    part = lambda name: F.sum(F.when(F.col("_w.name") == name, F.col("_w.weight") * F.col("_v"))).alias(name)
    return found.groupBy(*keys).agg(*[part(n) for n in points])


def rounds_for(n: int) -> int:
    """Rounds of ranges after which a range of ``n`` values holds about ``TASK_ROWS`` at most."""
    rounds = 0
    while n > TASK_ROWS:
        n, rounds = n // RANGES, rounds + 1
    return rounds


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], stored=None) -> DataFrame:
    """``keys`` and a column for each of ``points`` (name: share), interpolated between neighbours.

    Exact. Distinct values are counted, and written by ``stored(table, name)`` where it is given, so that the
    source is evaluated once; the ranges that hold a wanted rank are then cut anew until what one
    task orders is bounded, in as many rounds as the number of distinct values asks for.
    """
    rows = _counted(df, keys, value)
    if stored is None:
        return _ranked(rows, keys, points, 1)
    rows = stored(rows, "values")
    return _ranked(rows, keys, points, rounds_for(rows.count()))


def distribution(df: DataFrame, keys: list[str], value: str, digits: int = 6, stored=None) -> DataFrame:
    """count, min, p50, p95, max and mean; percentiles interpolate between neighbours (null without values)."""
    r = lambda c: F.bround(c, digits)
    numbers = ["count", "min", "max", "mean"]
    if stored is not None:
        rows = stored(df.select(*keys, F.col(value).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), "values")
        n = F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(0))
        out = rows.groupBy(*keys).agg(n.alias("count"), r(F.min("_v")).alias("min"), r(F.max("_v")).alias("max"), r(F.sum(F.col("_v") * F.col("_c")) / n).alias("mean"))
        points = _ranked(rows.filter("_v is not null"), keys, {"p50": 0.5, "p95": 0.95}, rounds_for(rows.count()))
    else:
        out = df.groupBy(*keys).agg(F.count(value).alias("count"), r(F.min(value)).alias("min"), r(F.max(value)).alias("max"), r(F.avg(value)).alias("mean"))
        points = percentiles(df, keys, value, {"p50": 0.5, "p95": 0.95})
    return _with(out, points.select(*keys, "p50", "p95"), keys, "left").select(*keys, *numbers[:3], numbers[3], r(F.col("p50")).alias("p50"), r(F.col("p95")).alias("p95"))


def totals(df: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    r = lambda c: F.bround(c, digits)
    return df.groupBy(*keys).agg(F.count(value).alias("count"), r(F.sum(value)).alias("sum"), r(F.avg(value)).alias("mean"))


def rate_per_minute(count: Column, duration_s: Column) -> Column:
    return F.when(duration_s <= 0, 0.0).otherwise(F.bround(count * 60 / duration_s, 6))


def vector_moments(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """count, mean, m2, sample variance and deviation per key and bin (null below two)."""
    bins = df.select(*keys, F.posexplode(vector).alias("bin", "x")).withColumn("x", F.col("x").cast("double"))
    out = bins.groupBy(*keys, "bin").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"), F.stddev_samp("x").alias("std"))
    return out.withColumn("m2", F.coalesce(F.col("variance") * (F.col("count") - 1), F.lit(0.0)))


def vector_means(vector: str) -> Column:
    """Mean of an array column's elements."""
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(vector))


def numeric_stats(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """count, mean, population deviation, min and max of several columns, a row each."""
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    rows = df.selectExpr(*keys, f"stack({len(columns)}, {pairs}) as (field, value)")
    out = rows.groupBy(*keys, "field").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return out.withColumn("status", F.when(F.col("count") > 0, "ok").otherwise("empty"))
