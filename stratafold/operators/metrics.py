"""Evaluation of boundaries, probabilities and curves."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def robust_variance(seq: DataFrame) -> DataFrame:
    """Noise variance per sequence from the MAD of differences: (1.4826 MAD / sqrt 2)^2, at least 1e-6."""
    d = seq.withColumn("d", F.col("y") - F.lag("y").over(Window.partitionBy("seq_id").orderBy("idx"))).where("d is not null")
    m = d.groupBy("seq_id").agg(F.median("d").alias("m"))
    mad = F.median(F.abs(F.col("d") - F.col("m")))
    return d.join(m, "seq_id").groupBy("seq_id").agg(F.greatest(F.pow(1.4826 * mad, 2) / 2, F.lit(1e-6)).alias("sigma2"))


def match(predicted: list[float], reference: list[float], tolerance: float) -> list[tuple[float, float]]:
    """One-to-one matches within the tolerance, as many as possible, then of least total distance. On a line some best
    matching never crosses, so an alignment of the two sorted lists finds it."""
    a, b = sorted(predicted), sorted(reference)
    best = [[(0, 0.0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        options = [best[i - 1][j], best[i][j - 1]]
        d = abs(a[i - 1] - b[j - 1])
        if d <= tolerance:
            options.append((best[i - 1][j - 1][0] + 1, best[i - 1][j - 1][1] - d))
        best[i][j] = max(options)
    out, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            out.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
    return out[::-1]


def greedy_match(predicted: list[float], reference: list[float], tolerance: float) -> list[tuple[float, float]]:
    """Shortest edges first; may match fewer than `match`."""
    edges = sorted((abs(p - r), p, r) for p in predicted for r in reference if abs(p - r) <= tolerance)
    used_p, used_r, out = set(), set(), []
    for _, p, r in edges:
        if p not in used_p and r not in used_r:
            used_p.add(p)
            used_r.add(r)
            out.append((p, r))
    return sorted(out)


def boundary_scores(boundaries: DataFrame, tolerances: tuple[float, ...] = (0, 1, 3, 5)) -> DataFrame:
    """boundaries (seq_id, kind predicted|reference, pos) to precision, recall, f1 and mae per tolerance. Both sides
    empty count as perfect; one empty side gives 0 and no mae."""

    def run(key, pdf):
        p, r = (pdf.loc[pdf["kind"] == k, "pos"].tolist() for k in ("predicted", "reference"))
        rows = []
        for t in tolerances:
            m = match(p, r, t)
            prec, rec = (len(m) / len(x) if x else float(not p and not r) for x in (p, r))
            f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
            mae = float(np.mean([abs(a - b) for a, b in m])) if m else None
            rows.append((key[0], float(t), len(m), prec, rec, f1, mae))
        return pd.DataFrame(rows, columns=["seq_id", "tolerance", "matched", "precision", "recall", "f1", "mae"])

    return boundaries.groupBy("seq_id").applyInPandas(run, "seq_id string, tolerance double, matched int, precision double, recall double, f1 double, mae double")


def probability_scores(marginal: DataFrame, truth: DataFrame) -> DataFrame:
    """marginal (seq_id, pos, p) against truth (seq_id, pos): mean Brier and log score (p clipped at 1e-12)."""
    t = marginal.join(truth.select("seq_id", "pos", F.lit(1.0).alias("hit")), ["seq_id", "pos"], "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p")))
    return t.groupBy("seq_id").agg(F.avg(F.pow(F.col("p") - F.col("hit"), 2)).alias("brier"), F.avg(F.when(F.col("hit") == 1, F.log(p)).otherwise(F.log1p(-p))).alias("log_score"))


def calibration(probs: DataFrame, bins: int = 10) -> DataFrame:
    """probs (p, hit, and a unique key) in equal-mass bins of floor(N / bins), the rest in the last: bin, n, mean_p, rate.
    Ranks come from per-bucket counts of a coarse grid of p first, so no task sorts everything."""
    grid = F.least(F.floor(F.col("p") * 1024), F.lit(1023)).cast("int")
    t = probs.withColumn("cell", grid)
    sizes = t.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("m").over(Window.partitionBy()))
    keys = [c for c in probs.columns if c not in ("p", "hit")]
    t = t.join(F.broadcast(before.drop("m")), "cell")  # at most 1,024 rows
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("p", *keys)) + F.col("before")
    size = F.greatest(F.lit(1), F.floor(F.col("total") / bins))
    t = t.withColumn("rank", rank).withColumn("bin", F.least(F.floor((F.col("rank") - 1) / size), F.lit(bins - 1)).cast("int"))
    return t.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("hit").alias("rate"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


#: P(weight <= k) of Poisson(1) for k = 0.., in units of 2^-32; what lies above the last is below the resolution.
POISSON_ONE = [int(2**32 * math.exp(-1) * sum(1 / math.factorial(m) for m in range(k + 1))) for k in range(13)]


def bootstrap_weights(values: DataFrame, key: list[str], draws: int, seed: int = 0) -> DataFrame:
    """Every row once per draw (0..draws - 1) in which its weight w, a Poisson(1) number, is not zero. The weight follows
    from a digest of the row's key, four draws from each, so it does not depend on partitions and a retry repeats it."""
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed)), F.col("_block").cast("string"))
    t = values.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 4)))).withColumn("_h", F.md5(text.cast("binary")))
    t = t.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("draw", (F.col("_block") * 4 + F.col("_c")).cast("int")).where(F.col("draw") < draws)
    u = F.conv(F.substring("_h", F.col("_c") * 8 + 1, F.lit(8)), 16, 10).cast("long")
    w = sum(F.when(u >= c, 1).otherwise(0) for c in POISSON_ONE)
    return t.withColumn("w", w).where("w > 0").drop("_block", "_c", "_h")


def bootstrap_ci(values: DataFrame, by: str, value: str, key: list[str], draws: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean: by, mean, low, high. A Poisson bootstrap: in each draw a row counts a Poisson(1)
    number of times, which needs no resampling of a group as a whole, so weighted sums combine map-side per (group, draw)
    and a group of any size is many tasks. `key` names columns that tell the rows of a group apart."""
    v = values.select(by, *[k for k in key if k != by], F.col(value).cast("double").alias("_v")).where("_v is not null")
    one = bootstrap_weights(v, [by, *key], draws, seed).groupBy(by, "draw").agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    q = one.groupBy(by).agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return v.groupBy(by).agg(F.avg("_v").alias("mean")).join(q, by, "left").select(by, "mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def ks_uniform(pit: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov distance of pit from uniform per sequence."""
    w = Window.partitionBy("seq_id")
    t = pit.withColumn("rn", F.row_number().over(w.orderBy("pit"))).withColumn("n", F.count(F.lit(1)).over(w))
    return t.groupBy("seq_id").agg(F.max(F.greatest(F.col("rn") / F.col("n") - F.col("pit"), F.col("pit") - (F.col("rn") - 1) / F.col("n"))).alias("ks"))


def k_width(posterior_k: DataFrame, mass: float = 0.95) -> DataFrame:
    """Width (max - min) of the smallest set of k that holds `mass`, most probable first."""
    by = Window.partitionBy("seq_id").orderBy(F.desc("post"), "k")
    t = posterior_k.withColumn("before", F.coalesce(F.sum("post").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).where(F.col("before") < mass)
    return t.groupBy("seq_id").agg((F.max("k") - F.min("k")).alias("width"), F.count(F.lit(1)).alias("size"))


def contingency(labels: DataFrame) -> DataFrame:
    return labels.groupBy("truth", "found").agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """Adjusted Rand index of (truth, found) from the contingency table."""
    c = contingency(labels)
    two = lambda x: F.col(x) * (F.col(x) - 1) / 2
    cells = c.agg(F.sum(two("n")).alias("cells"), F.sum("n").alias("total"))
    rows = c.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("a"))
    found = c.groupBy("found").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("b"))
    t = cells.join(rows, F.lit(True)).join(found, F.lit(True))  # one row each
    chance = F.col("a") * F.col("b") / two("total")
    return t.select(F.when((F.col("a") + F.col("b")) / 2 == chance, 1.0).otherwise((F.col("cells") - chance) / ((F.col("a") + F.col("b")) / 2 - chance)).alias("ari"))


def assignment(gain: np.ndarray) -> float:
    """The largest total of an assignment of rows to different columns (some may stay free; gains are not negative), by
    shortest augmenting paths with prices: cubic in the larger side."""
    n = max(gain.shape)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : gain.shape[0] + 1, 1 : gain.shape[1] + 1] = -gain
    row_price, price, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for r in range(1, n + 1):
        owner[0], j = r, 0
        slack, came, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[j]:
            used[j] = True
            free = np.flatnonzero(~used)
            reduced = cost[owner[j], free] - row_price[owner[j]] - price[free]
            better = reduced < slack[free]
            slack[free[better]], came[free[better]] = reduced[better], j
            nxt = free[slack[free].argmin()]
            d = slack[nxt]
            row_price[owner[used]] += d
            price[used] -= d
            slack[free] -= d
            j = int(nxt)
        while j:  # turn the path round
            owner[j], j = owner[came[j]], came[j]
    return float(-sum(cost[owner[j], j] for j in range(1, n + 1)))


def permuted_accuracy(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Best accuracy over relabellings of `found` for each value of the columns `by` (for all without): by, accuracy. An
    assignment on the contingency table, which has a row per pair of groups, in one small task per value."""
    keys = by or []
    c = labels.groupBy(*keys, "truth", "found").agg(F.count(F.lit(1)).alias("n"))
    c = c.select(*keys, F.col("truth").cast("string").alias("truth"), F.col("found").cast("string").alias("found"), "n")

    def run(key, pdf):
        t = pdf.fillna({"truth": "\0null", "found": "\0null"}).pivot_table(index="truth", columns="found", values="n", aggfunc="sum", fill_value=0).to_numpy(float)
        return pd.DataFrame([(*key, assignment(t) / t.sum())], columns=[*keys, "accuracy"])

    schema = ", ".join([*(f"{k} {labels.schema[k].dataType.simpleString()}" for k in keys), "accuracy double"])
    return c.groupBy(*keys).applyInPandas(run, schema)


def random_boundaries(n: int, k: int, min_len: int = 1, seed: int = 0) -> list[int]:
    """Boundaries of a uniformly drawn partition of n rows into k blocks of at least `min_len`: stars and bars."""
    free = n - k * min_len
    if k < 1 or free < 0:
        raise ValueError("no such partition")
    bars = np.sort(np.random.default_rng(seed).choice(free + k - 1, k - 1, replace=False))
    sizes = np.diff(np.concatenate([[-1], bars, [free + k - 1]])) - 1 + min_len
    return np.concatenate([[0], np.cumsum(sizes)]).tolist()


def signal_error(curve: DataFrame, truth: DataFrame, value: str = "mean") -> DataFrame:
    """Mean squared error of a curve (seq_id, idx, value) against the true signal (seq_id, idx, signal)."""
    return curve.join(truth, ["seq_id", "idx"]).groupBy("seq_id").agg(F.avg(F.pow(F.col(value) - F.col("signal"), 2)).alias("mse"))


def count_error(summary: DataFrame, truth: DataFrame) -> DataFrame:
    """Found less true number of segments (seq_id, k)."""
    return summary.join(truth, "seq_id").select("seq_id", (F.col("k_map") - F.col("k")).alias("error"), F.abs(F.col("k_map") - F.col("k")).alias("absolute"))


def window_scores(scored: DataFrame) -> DataFrame:
    """Held-out windows (seq_id, log_density, pit): mean log density, coverage of the central 95 %, distance from uniform."""
    mean = scored.groupBy("seq_id").agg(F.avg("log_density").alias("log_density"), F.avg(F.when(F.col("pit").between(0.025, 0.975), 1.0).otherwise(0.0)).alias("coverage"))
    return mean.join(ks_uniform(scored), "seq_id")


def mask_random(seq: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Hides rows completely at random, by a hash of the key so that reruns agree."""
    u = F.pmod(F.xxhash64("seq_id", "idx", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    return seq.withColumn("a", F.when(u < rate, 0.0).otherwise(F.col("a")))


def mask_block(seq: DataFrame, share: float = 0.15, at: float = 0.4) -> DataFrame:
    """Hides one run of floor(share n) rows that starts after floor(at n)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("seq_id"))
    lo = F.floor(n * at)
    return seq.withColumn("a", F.when((F.col("idx") > lo) & (F.col("idx") <= lo + F.floor(n * share)), 0.0).otherwise(F.col("a")))


def holdout(seq: DataFrame, low: float, high: float) -> DataFrame:
    """Adds `held`: rows between round(low n) and round(high n)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("seq_id"))
    return seq.withColumn("held", (F.col("idx") > F.round(n * low)) & (F.col("idx") <= F.round(n * high)))
