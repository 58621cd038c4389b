"""Partition priors: count priors over k, and factors per block from cohesion, hazard and length."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import cols

COUNT_PRIORS = {None: 0.5, "geometric_0.5": 0.5, "geometric_0.1": 0.1, "uniform": 1.0}


def count_prior(prior, k_max: int) -> np.ndarray:
    """log p(k) for k = 1..k_max; `prior` is a name, a rate, or a function of k. None is geometric with rate 1/2."""
    k = np.arange(1, k_max + 1)
    if callable(prior):
        p = np.array([float(prior(int(x))) for x in k])
    else:
        rate = prior if isinstance(prior, float) else COUNT_PRIORS[prior]
        p = rate ** (k - 1.0)
    if (p < 0).any() or not p.sum() > 0:
        raise ValueError("a count prior needs non-negative values with a positive total")
    return np.log(np.maximum(p / p.sum(), 1e-300))


def count_at(prior, k: int, k_max: int) -> float:
    """log p(k), for one k between 1 and k_max."""
    if not 1 <= k <= k_max:
        raise ValueError(f"k = {k} is not between 1 and {k_max}")
    return float(count_prior(prior, k_max)[k - 1])


def cohesion_at(span: float, power: float, scale: float = 1.0) -> float:
    """Log factor of one segment of that span."""
    if not (span > 0 and scale > 0):
        raise ValueError("spans and scales are positive")
    return power * math.log(span / scale)


def hazard_at(width: float, rate: float) -> float:
    """Log factor of one boundary after a segment of that width."""
    if not (width > 0 and rate > 0):
        raise ValueError("widths and rates are positive")
    return rate * width + math.log(-math.expm1(-rate * width))


def count_prior_table(spark: SparkSession, prior, k_max: int) -> DataFrame:
    return spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(count_prior(prior, k_max))], "k int, log_p double")


@dataclass(frozen=True)
class Partition:
    """cohesion: uniform, span or length (factor (span / scale) ** power); hazard: uniform or poisson (rate). `span` is a log
    factor of the caller's own, `span(length on the axis, ns)`, written against a namespace of functions so that the
    kernels (`segment.segment(span=..., on_axis=True)`) can use it too; blocks where it is not finite disappear.
    `blocks` (i, j, factor) and `boundaries` (pos, factor) are side tables that override by position."""

    cohesion: str = "uniform"
    power: float = 0.0
    scale: float = 1.0
    hazard: str = "uniform"
    rate: float = 1.0
    min_len: int = 1
    min_span: float = 0.0
    max_span: float = math.inf
    span: Callable | None = None
    blocks: DataFrame | None = field(default=None, compare=False)
    boundaries: DataFrame | None = field(default=None, compare=False)

    @property
    def plain(self) -> bool:
        return self == Partition() and self.blocks is None and self.boundaries is None


def hazard_term(width: Column, rate: float) -> Column:
    """log of L e^-L / (1 - e^-L) up to the normaliser of the block: L + ln(1 - e^-L) with L = rate * width."""
    lam = rate * width
    return lam + F.log(-F.expm1(-lam))


def with_prior(block: DataFrame, bound: DataFrame, prior: Partition) -> DataFrame:
    """Adds log_g; blocks without support disappear. `bound` (seq_id, pos, u) gives spans; the hazard of a boundary
    counts where a block stops before the sequence's end."""
    if prior.plain:
        return block.withColumn("log_g", F.lit(0.0))
    last = bound.groupBy("seq_id").agg(F.max("pos").alias("n"))
    from pyspark.sql import Window

    b = bound.withColumn("du", F.col("u") - F.lag("u").over(Window.partitionBy("seq_id").orderBy("pos"))).join(last, "seq_id")
    t = block.join(b.select("seq_id", F.col("pos").alias("i"), F.col("u").alias("ui")), ["seq_id", "i"])
    t = t.join(b.select("seq_id", F.col("pos").alias("j"), F.col("u").alias("uj"), "du", "n"), ["seq_id", "j"])
    span = F.col("uj") - F.col("ui")
    t = t.where((F.col("j") - F.col("i") >= prior.min_len) & (span >= prior.min_span) & (span <= prior.max_span))
    g = {"uniform": F.lit(0.0), "span": prior.power * F.log(span / prior.scale), "length": prior.power * F.log((F.col("j") - F.col("i")) / prior.scale)}[prior.cohesion]
    if prior.hazard == "poisson":
        g = g + F.when(F.col("j") < F.col("n"), hazard_term(F.col("du"), prior.rate)).otherwise(0.0)
    t = t.withColumn("log_g", g)
    if prior.span is not None:
        t = t.withColumn("f", prior.span(span, cols)).where("f > double('-inf') and f < double('inf')").withColumn("log_g", F.col("log_g") + F.col("f")).drop("f")
    if prior.blocks is not None:  # explicit factors, small side tables: 0 removes the block
        t = t.join(prior.blocks.select("i", "j", F.col("factor").alias("f")), ["i", "j"], "left").where("f is null or f > 0").withColumn("log_g", F.col("log_g") + F.log(F.coalesce("f", F.lit(1.0)))).drop("f")
    if prior.boundaries is not None:
        t = t.join(prior.boundaries.select(F.col("pos").alias("j"), F.col("factor").alias("f")), ["j"], "left").where("j = n or f is null or f > 0")
        t = t.withColumn("log_g", F.col("log_g") + F.when(F.col("j") < F.col("n"), F.log(F.coalesce("f", F.lit(1.0)))).otherwise(0.0)).drop("f")
    return t.select(*block.columns, "log_g")


def log_ck_uniform(n: Column, k: Column) -> Column:
    """ln C(n - 1, k - 1)."""
    return cols.lnchoose(n.cast("double") - 1, k.cast("double") - 1)


def partition_log_prior(blocks: DataFrame, segment: DataFrame) -> DataFrame:
    """Sum of log_g along each sequence's segments (seq_id, i, j); null where a segment has no support."""
    t = segment.select("seq_id", "i", "j").join(blocks.select("seq_id", "i", "j", "log_g"), ["seq_id", "i", "j"], "left")
    return t.groupBy("seq_id").agg(F.when(F.count_if(F.col("log_g").isNull()) == 0, F.sum("log_g")).alias("log_prior"))
