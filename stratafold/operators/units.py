"""Set-valued units: intervals that overlap and differ per sequence, and what the points inside them add up to.

Points meet intervals by an equi-join on cells. An interval of length l goes into the cells of width 2^ceil(log2 l), so it
lies in two of them at most, however long it is; a point goes into one cell of each width in use. Nearly all pairs that
meet are pairs of the result (a cell is less than twice as wide as its intervals), cells are hashed, so neither a long
sequence nor a long interval is one task, and no range condition is left without an equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_sum

#: Stands for the width of intervals without an end.
ENDLESS = 4096


def _cell(x, level):
    """The number of the cell of width 2^level that holds x; scaling by a power of two, in two steps that stay in range, is
    exact. Coordinates too far away for a cell's number share the last one."""
    half = F.floor(level / 2)
    near = x * F.pow(F.lit(2.0), -half.cast("double")) * F.pow(F.lit(2.0), (half - level).cast("double"))
    return F.when(level == ENDLESS, F.lit(0)).otherwise(F.floor(F.greatest(F.lit(-9e18), F.least(F.lit(9e18), near))))


def in_intervals(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """`points` (seq_id, x, more columns) with unit_id, low and high of every interval (seq_id, unit_id, low, high) that
    holds them: low < x <= high. Null or NaN ends and coordinates, and intervals that are empty, hold nothing."""
    size = F.col("high") - F.col("low")
    level = F.when(size == float("inf"), F.lit(ENDLESS)).otherwise(F.ceil(F.log2(size)))
    iv = intervals.select("seq_id", "unit_id", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
    iv = iv.where("low < high and not isnan(high)").withColumn("level", level.cast("int"))
    levels = sorted(r["level"] for r in iv.select("level").distinct().collect())  # exponents of doubles: some 2,100 at most
    if not levels:
        levels = [0]
    low, high = _cell(F.col("low"), F.col("level")), _cell(F.col("high"), F.col("level"))
    iv = iv.withColumn("cell", F.explode(F.array_distinct(F.array(low, high))))
    pt = points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    pt = pt.withColumn("cell", _cell(F.col("x").cast("double"), F.col("level")))
    met = pt.join(iv, ["seq_id", "level", "cell"]).where((F.col("x") > F.col("low")) & (F.col("x") <= F.col("high")))
    return met.drop("level", "cell")


def unit_log_likelihood(scored: DataFrame, intervals: DataFrame) -> DataFrame:
    """For each interval the sum of `log_density` over the points of its sequence inside it, 0 if there are none: seq_id,
    unit_id, low, high, n_points, log_score. The sums do not depend on the order of rows."""
    inside = in_intervals(scored.select("seq_id", "x", "log_density"), intervals)
    one = inside.groupBy("seq_id", "unit_id", "low", "high").agg(F.count(F.lit(1)).alias("n"), exact_sum("log_density").alias("s"))
    every = intervals.select("seq_id", "unit_id", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
    return every.join(one, ["seq_id", "unit_id", "low", "high"], "left").select(
        "seq_id", "unit_id", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n_points"), F.coalesce("s", F.lit(0.0)).alias("log_score")
    )
