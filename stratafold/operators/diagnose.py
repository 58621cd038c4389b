"""Checks of a fit, block errors and their propagation, prior sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segment


def invariants(fit: segment.Fit) -> DataFrame:
    """One row per check and sequence: measured, tolerance, passed."""
    r = fit.rows.where("error is null")
    k = F.col("k_map")
    checks = {
        "posterior_sums_to_one": (F.abs(F.aggregate("log_post", F.lit(0.0), lambda a, x: a + F.exp(x)) - 1), 1e-9),
        "left_equals_right": (F.abs(F.element_at("log_left_n", k) - F.element_at("log_right_0", k)), 1e-6),
        "marginals_sum_to_k_minus_1": (F.abs(F.aggregate("marginal", F.lit(0.0), lambda a, x: a + x) - (k - 1)), 1e-6),
        "map_within_sum": (F.greatest(F.lit(0.0), F.col("log_joint_map") - F.element_at("log_left_n", k)), 1e-9),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("name"), m.cast("double").alias("measured"), F.lit(t).alias("tolerance")) for n, (m, t) in checks.items()])
    c = r.select("seq_id", F.explode(rows).alias("c")).select("seq_id", "c.*")
    return c.withColumn("passed", F.col("measured") <= F.col("tolerance"))


def report(checks: DataFrame) -> DataFrame:
    """One JSON document per sequence."""
    one = checks.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("name", "measured", "tolerance", "passed"))).alias("checks"), F.bool_and("passed").alias("passed"))
    return one.select("seq_id", F.to_json(F.struct("passed", "checks")).alias("report"))


def map_score_check(fit: segment.Fit, blocks: DataFrame) -> DataFrame:
    """Score of the stored segmentation summed from the block table, against the stored score."""
    path = fit.segment.select("seq_id", "i", "j").join(blocks, ["seq_id", "i", "j"]).groupBy("seq_id").agg(F.sum("log_a0").alias("path"))
    return path.join(fit.summary, "seq_id").select("seq_id", F.abs(F.col("path") - F.col("log_joint_map")).alias("gap"))


def reachable(blocks: DataFrame, k_max: int, rule: str = "rows") -> DataFrame:
    """Blocks that some partition into at most k_max blocks uses. rule `rows` counts the left-over observations as if
    each were a block; `blocks` counts the sides only."""
    n = blocks.groupBy("seq_id").agg(F.max("j").alias("n"))
    t = blocks.join(n, "seq_id")
    if rule == "rows":
        return t.where(F.col("i") + F.col("n") - F.col("j") + 1 <= k_max)
    return t.where((F.col("i") > 0).cast("int") + 1 + (F.col("j") < F.col("n")).cast("int") <= k_max)


def block_error(exact: DataFrame, approx: DataFrame, k_max: int, rule: str = "blocks") -> DataFrame:
    """Per sequence: support mismatches, maximal, median and mean absolute error of log evidence on reachable blocks."""
    a = reachable(exact, k_max, rule).select("seq_id", "i", "j", F.col("log_a0").alias("e"))
    b = reachable(approx, k_max, rule).select("seq_id", "i", "j", F.col("log_a0").alias("f"))
    t = a.join(b, ["seq_id", "i", "j"], "full_outer")
    d = F.abs(F.col("e") - F.col("f"))
    return t.groupBy("seq_id").agg(
        F.count_if(F.col("e").isNull() | F.col("f").isNull()).alias("mismatched"), F.max(d).alias("max_error"), F.median(d).alias("median_error"), F.avg(d).alias("mean_error")
    )


def bounds(error: DataFrame, k_max: int) -> DataFrame:
    """What a block error of max_error allows: log weight eta = k_max * error, log odds 2 eta, ratios e^(+-2 eta), and a
    total variation of at most min(1, e^(2 eta) - 1)."""
    eta = F.col("max_error") * k_max
    return error.select("seq_id", eta.alias("eta"), (2 * eta).alias("log_odds"), F.exp(-2 * eta).alias("ratio_low"), F.exp(F.least(2 * eta, F.lit(700.0))).alias("ratio_high"), F.least(F.lit(1.0), F.expm1(F.least(2 * eta, F.lit(700.0)))).alias("tv"))


def compare(a: segment.Fit, b: segment.Fit) -> DataFrame:
    """L1 distance of p(k) and of mixed boundary marginals, and Jaccard of MAP boundaries."""
    pk = a.posterior_k.select("seq_id", "k", F.col("post").alias("p")).join(b.posterior_k.select("seq_id", "k", F.col("post").alias("q")), ["seq_id", "k"], "full_outer")
    pk = pk.groupBy("seq_id").agg(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("l1_k"))
    m = a.boundary_marginal_mixed.join(b.boundary_marginal_mixed.withColumnRenamed("p", "q"), ["seq_id", "pos"]).groupBy("seq_id").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("l1_marginal"), F.max(F.abs(F.col("p") - F.col("q"))).alias("max_marginal"))
    inner = lambda c: F.slice(c, 2, F.greatest(F.lit(0), F.size(c) - 2))
    s = a.rows.select("seq_id", inner(F.col("boundaries")).alias("x")).join(b.rows.select("seq_id", inner(F.col("boundaries")).alias("y")), "seq_id")
    u = F.size(F.array_union("x", "y"))
    s = s.select("seq_id", F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect("x", "y")) / u).alias("jaccard"))
    return pk.join(m, "seq_id").join(s, "seq_id")


def non_conjugate(approx: segment.Fit, exact: segment.Fit, approx_blocks: DataFrame, exact_blocks: DataFrame, k_max: int, quantiles: tuple[float, ...] = (0.5, 0.95, 1.0)) -> DataFrame:
    """An approximate fit against a reference, one row per sequence: errors of log evidence on reachable blocks (maximum,
    median, mean, `quantiles`), distances of the posteriors, overlap of MAP boundaries, the total variation of p(k) with
    the bound that the largest error allows, and whether the bound holds."""
    e = block_error(exact_blocks, approx_blocks, k_max)
    a = reachable(exact_blocks, k_max, "blocks").select("seq_id", "i", "j", F.col("log_a0").alias("e"))
    d = a.join(approx_blocks.select("seq_id", "i", "j", "log_a0"), ["seq_id", "i", "j"]).groupBy("seq_id").agg(F.percentile(F.abs(F.col("e") - F.col("log_a0")), F.array(*[F.lit(q) for q in quantiles])).alias("quantiles"))
    t = e.join(d, "seq_id").join(bounds(e, k_max).select("seq_id", F.col("tv").alias("tv_bound")), "seq_id").join(compare(exact, approx), "seq_id")
    return t.withColumn("tv", F.col("l1_k") / 2).withColumn("bound_holds", F.col("l1_k") / 2 <= F.col("tv_bound") + 1e-9)


SENSITIVITY = {"uniform": 1.0, "geometric_0.8": 0.8, "inverse": lambda k: 1.0 / k}


def prior_sensitivity(blocks: DataFrame, k_max: int, base=None) -> DataFrame:
    """The posterior under other count priors and a length factor, on the same block table: one row per variant."""
    ref = segment.fit_blocks(blocks, k_max, base, curves=False)
    out = None
    variants = {n: (blocks, c) for n, c in SENSITIVITY.items()}
    for p in (0.5, 1.0):
        variants[f"length_{p}"] = (blocks.withColumn("log_g", p * F.log((F.col("j") - F.col("i")).cast("double"))), base)
    for name, (b, count) in variants.items():
        one = compare(ref, segment.fit_blocks(b, k_max, count, curves=False)).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
