"""Prediction from fitted segments: as-of assignment, predictive densities, PIT, traces and set-valued units."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import incomplete
from ..functions.special import cols, normal_cdf
from . import families

POLICIES = ("error", "nearest", "clip", "left_endpoint", "right_endpoint")


def locate(seq: DataFrame, queries: DataFrame, policy: str = "nearest") -> DataFrame:
    """Adds `idx`: the training row at or before each query's x (a backward as-of join by one sort per sequence).
    Outside the training range the end rows serve if the policy allows that side; otherwise the query fails."""
    if policy not in POLICIES:
        raise ValueError(f"unknown extrapolation policy {policy!r}")
    cols_q = [c for c in queries.columns if c not in ("seq_id", "x")]
    train = seq.select("seq_id", "x", F.lit(0).alias("kind"), F.col("idx").alias("at"), F.lit(None).alias("q"))
    asked = queries.select("seq_id", F.col("x").cast("double").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("at"), F.struct(F.lit(1).alias("one"), *cols_q).alias("q"))
    both = train.withColumn("q", F.lit(None).cast(asked.schema["q"].dataType)).unionByName(asked)
    back = Window.partitionBy("seq_id").orderBy("x", "kind")
    top = F.max(F.when(F.col("kind") == 0, F.col("x"))).over(Window.partitionBy("seq_id"))
    t = both.withColumn("at", F.last("at", True).over(back)).withColumn("top", top).where("kind = 1")
    low, high = F.col("at").isNull(), F.col("x") > F.col("top")
    bad = {"error": low | high, "left_endpoint": high, "right_endpoint": low}.get(policy, F.lit(False))
    t = t.withColumn("idx", F.when(bad, F.raise_error("query outside the training range").cast("int")).otherwise(F.coalesce("at", F.lit(1))))
    return t.select("seq_id", "x", "idx", *[F.col(f"q.{c}").alias(c) for c in cols_q])


def to_segment(located: DataFrame, segment: DataFrame) -> DataFrame:
    """Adds the segment (q, i, j, mean) that holds each located row. A sequence's segments come as one array, so a query
    never meets those that do not hold it as rows."""
    s = segment.groupBy("seq_id").agg(F.collect_list(F.struct("q", "i", "j", "mean")).alias("_s"))
    t = located.join(s, "seq_id").withColumn("_s", F.get(F.filter("_s", lambda s: (F.col("idx") > s["i"]) & (F.col("idx") <= s["j"])), F.lit(0)))
    return t.where("_s is not null").select(*located.columns, "_s.q", "_s.i", "_s.j", "_s.mean")


def predict(seq: DataFrame, segment: DataFrame, queries: DataFrame, policy: str = "nearest") -> DataFrame:
    return to_segment(locate(seq, queries, policy), segment)


def segment_sums(seq: DataFrame, name: str, segment: DataFrame, hyper: DataFrame) -> DataFrame:
    """Per segment the sums s_<term> of the family's terms and the hyperparameters: all that its posterior needs."""
    p = families.prefix(seq, name)
    keys = [c for c in p.columns if c.startswith("p_")]
    a = p.select("seq_id", F.col("pos").alias("i"), *[F.col(c).alias(f"i_{c}") for c in keys])
    b = p.select("seq_id", F.col("pos").alias("j"), *[F.col(c).alias(f"j_{c}") for c in keys])
    t = segment.join(a, ["seq_id", "i"]).join(b, ["seq_id", "j"]).join(hyper, "seq_id")
    return t.select("seq_id", "q", "i", "j", "mean", *[(F.col(f"j_{c}") - F.col(f"i_{c}")).alias(f"s_{c[2:]}") for c in keys], *[c for c in hyper.columns if c != "seq_id"])


def _beta(c):
    return c("alpha") + c("s_s"), c("beta") + c("s_m") - c("s_s")


def log_density(name: str, y=None):
    """Predictive log density as a Column over segment sums, hyperparameters and the query's y, w, n_trials, r."""
    c, ns = F.col, cols
    y = c("y") if y is None else y
    if name == "gaussian":
        mu = (c("rho2") * c("s_s") + c("sigma2") * c("nu")) / (c("rho2") * c("s_w") + c("sigma2"))
        v = c("sigma2") / F.greatest(c("w"), F.lit(1e-12)) + c("rho2") * c("sigma2") / (c("rho2") * c("s_w") + c("sigma2"))
        return -0.5 * F.log(2 * math.pi * v) - (y - mu) * (y - mu) / (2 * v)
    if name == "poisson":
        r, b = c("alpha") + c("s_s"), c("beta") + c("s_e")
        return ns.lgamma(y + r) - ns.lgamma(r) - ns.lgamma(y + 1.0) + r * F.log(b / (b + c("w"))) + y * F.log(c("w") / (b + c("w")))
    if name == "negbin":
        a, b = c("alpha") + c("s_m"), c("beta") + c("s_s")
        return ns.lgamma(y + c("r")) - ns.lgamma(y + 1.0) - ns.lgamma(c("r")) + ns.lnbeta(a + c("r"), b + y) - ns.lnbeta(a, b)
    a, b = _beta(c)
    if name == "binomial":
        return ns.lnchoose(c("n_trials"), y) + ns.lnbeta(a + y, b + c("n_trials") - y) - ns.lnbeta(a, b)
    if name == "bernoulli":
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), a / (a + b)))
        return y * F.log(p) + (1 - y) * F.log(1 - p)
    if name == "beta":  # the posterior density of the mean, evaluated at y
        return (a - 1) * F.log(y) + (b - 1) * F.log(1 - y) - ns.lnbeta(a, b)
    raise ValueError(f"no predictive density for {name!r}")


def node_weights(seq: DataFrame, name: str, segment: DataFrame, hyper: DataFrame, nodes: int) -> DataFrame:
    """Posterior log weights of the quadrature nodes on each segment: seq_id, q, i, j, g, value (the node's mean), lw, so
    that the weights of a segment sum to one."""
    from . import quadrature

    kind = "legendre" if name == "beta_obs" else "hermite"
    t = seq.join(segment.select("seq_id", "q", "i", "j"), "seq_id").where((F.col("idx") > F.col("i")) & (F.col("idx") <= F.col("j"))).join(hyper, "seq_id")
    t = t.withColumn("nd", F.explode(quadrature.nodes_of(kind, nodes))).select("*", "nd.*").drop("nd")
    base, v, value = quadrature.node_terms(name)
    s = t.groupBy("seq_id", "q", "i", "j", "g").agg(F.first(value).alias("value"), (F.first(base) + F.sum(F.col("a") * F.col("w") * v)).alias("lw"))
    by = Window.partitionBy("seq_id", "q")
    top = F.max("lw").over(by)
    s = s.withColumn("top", top).withColumn("z", F.log(F.sum(F.exp(F.col("lw") - F.col("top"))).over(by)))
    return s.select("seq_id", "q", "i", "j", "g", "value", (F.col("lw") - F.col("top") - F.col("z")).alias("lw"))


def score_nodes(seq: DataFrame, name: str, segment: DataFrame, hyper: DataFrame, queries: DataFrame, nodes: int = 32, policy: str = "nearest") -> DataFrame:
    """Queries (seq_id, x, y, a unique `point`, phi) with log_density and pit. Beta observations: the mixture of Beta(phi
    m, phi (1 - m)) over the nodes' means m, and its distribution function; -inf and 0 or 1 off the support. Logistic-
    normal: a Bernoulli with the posterior mean rate, clipped; no pit."""
    from . import quadrature

    w = node_weights(seq, name, segment, hyper, nodes).drop("i", "j")
    at = to_segment(locate(seq, queries, policy), segment).drop("i", "j", "mean")
    if name == "logistic_normal":
        rate = w.groupBy("seq_id", "q").agg(F.sum(F.exp("lw") * F.col("value")).alias("rate"))
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("rate")))
        t = at.join(rate, ["seq_id", "q"])
        return t.withColumn("log_density", F.col("y") * F.log(p) + (1 - F.col("y")) * F.log1p(-p)).withColumn("pit", F.lit(None).cast("double"))
    t = at.join(w, ["seq_id", "q"])
    inside = (F.col("y") > 0) & (F.col("y") < 1)
    y = F.when(inside, F.col("y")).otherwise(0.5)
    t = t.withColumn("l", F.col("lw") + quadrature._beta_node_terms(y, F.col("phi"), F.col("value"), cols))
    t = t.withColumn("below", F.exp("lw") * incomplete_beta(F.col("y"), F.col("phi") * F.col("value"), F.col("phi") * (1 - F.col("value"))))
    keys = ["seq_id", "point", "x", "y"]
    top = F.max("l").over(Window.partitionBy("seq_id", "point"))
    one = t.withColumn("top", top).groupBy(*keys).agg((F.first("top") + F.log(F.sum(F.exp(F.col("l") - F.col("top"))))).alias("d"), F.sum("below").alias("pit"))
    return one.select(*keys, F.when((F.col("y") > 0) & (F.col("y") < 1), F.col("d")).otherwise(float("-inf")).alias("log_density"), "pit")


def incomplete_beta(x, a, b):
    """The regularised incomplete beta function as a Column: whole Arrow batches at once."""

    def run(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(incomplete.incomplete_beta(x.to_numpy(float), a.to_numpy(float), b.to_numpy(float)))

    return F.pandas_udf(run, "double")(x, a, b)


def beta_less(a1, b1, a2, b2):
    """P(U <= V) for U ~ Beta(a1, b1), V ~ Beta(a2, b2) as a Column: whole Arrow batches at once."""

    def run(a1: pd.Series, b1: pd.Series, a2: pd.Series, b2: pd.Series) -> pd.Series:
        return pd.Series(incomplete.beta_less(*(v.to_numpy(float) for v in (a1, b1, a2, b2))))

    return F.pandas_udf(run, "double")(a1, b1, a2, b2)


def predict_bayes(seq: DataFrame, curve: DataFrame, queries: DataFrame, column: str = "bayes_mixed", policy: str = "nearest") -> DataFrame:
    """Posterior mean curve at each query: the value at the training row at or before it."""
    return locate(seq, queries, policy).join(curve.select("seq_id", "idx", F.col(column).alias("mean")), ["seq_id", "idx"])


def policy_record(seq: DataFrame, policy: str) -> DataFrame:
    """What a prediction was made under: seq_id, low, high (the training range), policy."""
    if policy not in POLICIES:
        raise ValueError(f"unknown extrapolation policy {policy!r}")
    return seq.groupBy("seq_id").agg(F.min("x").alias("low"), F.max("x").alias("high")).withColumn("policy", F.lit(policy))


def score_points(seq: DataFrame, name: str, segment: DataFrame, hyper: DataFrame, queries: DataFrame, policy: str = "nearest") -> DataFrame:
    """Queries (seq_id, x, y and descriptors) with log_density under the segment that holds them."""
    if name in ("beta_obs", "logistic_normal"):
        return score_nodes(seq, name, segment, hyper, queries, policy=policy)
    s = segment_sums(seq, name, segment, hyper)
    q = locate(seq, queries, policy)
    for k, v in {"w": 1.0, "n_trials": 1.0, "r": 1.0}.items():
        if k not in q.columns:
            q = q.withColumn(k, F.lit(v))
    t = to_segment(q, segment).drop("i", "j", "mean").join(s, ["seq_id", "q"])
    return t.withColumn("log_density", log_density(name))


def trace(scored: DataFrame) -> DataFrame:
    """Held-out log density in order of x, accumulated, with the share of points so far."""
    by = Window.partitionBy("seq_id").orderBy("x")
    n = F.count(F.lit(1)).over(Window.partitionBy("seq_id"))
    return scored.withColumn("total", F.sum("log_density").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("share", F.row_number().over(by) / n)


def pit_gaussian(scored: DataFrame) -> DataFrame:
    """Adds z and pit = Phi(z), by an Arrow-batched kernel: Spark SQL has no error function."""
    def phi(z: pd.Series) -> pd.Series:
        return pd.Series(normal_cdf(z.to_numpy()))

    c = F.col
    mu = (c("rho2") * c("s_s") + c("sigma2") * c("nu")) / (c("rho2") * c("s_w") + c("sigma2"))
    v = c("sigma2") / F.greatest(c("w"), F.lit(1e-12)) + c("rho2") * c("sigma2") / (c("rho2") * c("s_w") + c("sigma2"))
    return scored.withColumn("z", (c("y") - mu) / F.sqrt(v)).withColumn("pit", F.pandas_udf(phi, "double")("z"))


def pit_bounds(scored: DataFrame, name: str) -> DataFrame:
    """Discrete PIT: pit_low = F(y - 1) and pit_high = F(y). A predictive distribution function at a count is one
    incomplete beta function (Poisson) or the probability that one beta variable is below another (binomial, negative
    binomial), whatever the count; none is a sum over counts."""
    c, y = F.col, F.col("y").cast("double")
    one = F.lit(1.0)
    if name == "poisson":
        below = incomplete_beta((c("beta") + c("s_e")) / (c("beta") + c("s_e") + c("w")), c("alpha") + c("s_s"), F.greatest(y, one))
    elif name == "negbin":
        below = beta_less(c("r"), F.greatest(y, one), c("alpha") + c("s_m"), c("beta") + c("s_s"))
    elif name == "binomial":
        a, b = _beta(c)
        below = beta_less(c("n_trials") - y + 1.0, F.greatest(y, one), b, a)
    elif name == "bernoulli":
        a, b = _beta(c)
        below = 1.0 - F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), a / (a + b)))
    else:
        raise NotImplementedError(f"no discrete probability integral transform for {name!r}")
    t = scored.withColumn("pit_low", F.when(y > 0, below).otherwise(0.0))
    return t.withColumn("pit_high", F.least(one, F.col("pit_low") + F.exp("log_density")))


def pit(scored: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """Adds pit under any family that `score_points` scores: continuous ones directly, discrete ones between F(y - 1) and
    F(y) at random. (Beta observations have it from `score_nodes`; the logistic-normal family has none.)"""
    if name == "gaussian":
        return pit_gaussian(scored)
    if name == "beta":
        a, b = _beta(F.col)
        return scored.withColumn("pit", incomplete_beta(F.col("y"), a, b))
    if name in ("poisson", "negbin", "binomial", "bernoulli"):
        return randomised_pit(pit_bounds(scored, name), seed)
    raise NotImplementedError(f"no probability integral transform for {name!r}")


def randomised_pit(bounded: DataFrame, seed: int = 0) -> DataFrame:
    """Adds pit, a number between pit_low and pit_high drawn from a hash of the point: its sequence, position and value and,
    where there is one, its `point`. A task that runs again draws the same."""
    key = [k for k in ("seq_id", "unit_id", "point", "x", "y") if k in bounded.columns]
    u = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11).cast("double") * F.lit(2.0**-53)
    return bounded.withColumn("pit", F.col("pit_low") + u * (F.col("pit_high") - F.col("pit_low")))


def softmax(df: DataFrame, value: str, by: list[str], name: str = "prob") -> DataFrame:
    w = Window.partitionBy(*by)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return df.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def unit_scores(scored_points: DataFrame) -> DataFrame:
    """Sum of log densities over the inner points of each unit and group; a unit without points scores 0."""
    return scored_points.groupBy("unit_id", "seq_id").agg(F.sum(F.coalesce("log_density", F.lit(0.0))).alias("log_score"))


def unit_responsibility(scores: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Group probabilities of each unit, with an optional (seq_id, weight) prior."""
    s = scores if prior is None else scores.join(prior, "seq_id").withColumn("log_score", F.col("log_score") + F.log(F.greatest("weight", F.lit(1e-300))))
    return softmax(s, "log_score", ["unit_id"])


def interval_units(points: DataFrame, edges: list[float]) -> DataFrame:
    """Points (x, ...) with `unit_id`, low and high of the interval (low, high] between neighbouring edges that holds x;
    points outside all intervals go. Each point meets the edges by a binary search of the literal list, not by a join."""
    if len(edges) < 2 or any(not a < b for a, b in zip(edges[:-1], edges[1:], strict=True)):
        raise ValueError("intervals need increasing edges")

    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(), side="left") - 1, dtype="int32")

    t = points.withColumn("unit_id", F.pandas_udf(place, "int")("x")).where(F.col("unit_id").between(0, len(edges) - 2))
    at = F.array(*[F.lit(float(e)) for e in edges])
    return t.withColumn("low", F.get(at, F.col("unit_id"))).withColumn("high", F.get(at, F.col("unit_id") + 1))


def predict_group(scored: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Groups of fresh data from points scored under every group (unit_id, seq_id, log_density): log_score, the sum over
    all points of all units, and prob under the optional (seq_id, weight) prior; one row per group."""
    total = unit_scores(scored.withColumn("unit_id", F.lit(0)))
    out = unit_responsibility(total.withColumn("raw", F.col("log_score")), prior)
    return out.select("seq_id", F.col("raw").alias("log_score"), "prob")
