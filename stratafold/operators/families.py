"""Observation families: sufficient terms per row, evidence and posterior mean per block, hyperparameters per sequence.

`terms` gives per-row quantities whose sums over a block are all that `evidence` needs, so block values are differences
of two prefix sums. All formulas are written against a namespace and serve Columns and numpy arrays alike. The power `a`
(0 for hidden rows) scales every family's terms.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import cols
from . import diagonals

KAPPA = 20.0  # pseudo-count of the fractional beta family


def _gaussian_terms(r, ns):
    aw = r["a"] * r["w"]
    return {"n": r["a"], "w": aw, "s": aw * r["y"], "q": aw * r["y"] * r["y"], "l": ns.where(r["w"] > 0, r["a"] * ns.ln(ns.greatest(r["w"], 1e-300)), 0.0)}


def _gaussian(b, h, ns):
    ev = (
        -0.5 * b["n"] * ns.ln(2 * math.pi * h["sigma2"]) + 0.5 * b["l"] - 0.5 * ns.log1p(b["w"] * h["rho2"] / h["sigma2"])
        + ((b["s"] - h["nu"] * b["w"]) * (b["s"] - h["nu"] * b["w"]) / (b["w"] + h["sigma2"] / h["rho2"]) - (b["q"] - 2.0 * h["nu"] * b["s"] + h["nu"] * h["nu"] * b["w"])) / (2.0 * h["sigma2"])
    )
    return ev, (h["rho2"] * b["s"] + h["sigma2"] * h["nu"]) / (h["rho2"] * b["w"] + h["sigma2"])


def _poisson_terms(r, ns):
    log_e = ns.where(r["w"] > 0, ns.ln(ns.greatest(r["w"], 1e-300)), 0.0)
    return {"s": r["a"] * r["y"], "e": r["a"] * r["w"], "k": r["a"] * (r["y"] * log_e - ns.lgamma(r["y"] + 1.0))}


def _poisson(b, h, ns):
    al, be = h["alpha"], h["beta"]
    ev = b["k"] + al * ns.ln(be) - ns.lgamma(al) + ns.lgamma(al + b["s"]) - (al + b["s"]) * ns.ln(be + b["e"])
    return ev, (al + b["s"]) / (be + b["e"])


def _binomial_terms(r, ns):
    aw = r["a"] * r["w"]
    return {"s": aw * r["y"], "m": aw * r["n_trials"], "k": aw * ns.lnchoose(r["n_trials"], r["y"])}


def _beta_update(b, h, ns):
    al, be = h["alpha"], h["beta"]
    prior = h["log_prior"] if "log_prior" in h else ns.lnbeta(al, be)
    return b["k"] + ns.lnbeta(al + b["s"], be + b["m"] - b["s"]) - prior, (al + b["s"]) / (al + be + b["m"])


def _bernoulli_terms(r, ns):
    aw = r["a"] * r["w"]
    return {"s": aw * r["y"], "m": aw, "k": 0.0 * aw}


def _beta_terms(r, ns):
    aw, s, f = r["a"] * r["w"], KAPPA * r["y"], KAPPA * (1.0 - r["y"])
    return {"s": aw * s, "m": aw * KAPPA, "k": aw * (ns.lgamma(KAPPA + 1.0 + 0.0 * s) - ns.lgamma(s + 1.0) - ns.lgamma(f + 1.0))}


def _negbin_terms(r, ns):
    aw = r["a"] * r["w"]
    return {"m": aw * r["r"], "s": aw * r["y"], "k": aw * (ns.lgamma(r["y"] + r["r"]) - ns.lgamma(r["y"] + 1.0) - ns.lgamma(r["r"])), "rs": r["r"], "c": 0.0 * r["r"] + 1.0}


def _negbin(b, h, ns):
    al, be = h["alpha"] + b["m"], h["beta"] + b["s"]
    ev = b["k"] + ns.lnbeta(al, be) - ns.lnbeta(h["alpha"], h["beta"])
    return ev, ns.where(al > 1.0, b["rs"] / b["c"] * be / ns.where(al > 1.0, al - 1.0, 1.0), float("nan"))


FAMILIES = {
    "gaussian": (_gaussian_terms, _gaussian, ("nu", "rho2", "sigma2")),
    "poisson": (_poisson_terms, _poisson, ("alpha", "beta")),
    "binomial": (_binomial_terms, _beta_update, ("alpha", "beta")),
    "bernoulli": (_bernoulli_terms, _beta_update, ("alpha", "beta")),
    "beta": (_beta_terms, _beta_update, ("alpha", "beta")),
    "negbin": (_negbin_terms, _negbin, ("alpha", "beta")),
}
ALIASES = {"normal": "gaussian", "negative-binomial": "negbin", "nb": "negbin", "beta-binomial": "binomial", "fractional-beta": "beta"}
ROW = ("y", "w", "a", "n_trials", "r", "phi")


def family(name: str) -> str:
    key = name.strip().lower().replace("_", "-")
    key = ALIASES.get(key, key.replace("-", "_"))
    if key not in FAMILIES and key not in ("beta_obs", "logistic_normal"):
        raise ValueError(f"unknown family {name!r}")
    return key


def hyper(seq: DataFrame, name: str, mode: str = "cov", given: dict[str, float] | None = None) -> DataFrame:
    """Empirical-Bayes hyperparameters per sequence: seq_id and the family's names; `given` values win. Two grouped
    aggregates over observed rows (a > 0), both combined map-side."""
    s = seq.where("a > 0")
    one = lambda e: F.sum(e)
    if name == "gaussian":
        by = Window.partitionBy("seq_id").orderBy("idx")
        s = s.withColumn("y2", F.lead("y").over(by)).withColumn("d", (F.col("w") + F.lead("w").over(by)) / 2)
        m = s.groupBy("seq_id").agg((one(F.col("w") * F.col("y")) / one("w")).alias("nu"))
        t = s.join(m, "seq_id")
        sd = F.greatest(F.coalesce(one("d"), F.lit(0.0)), F.lit(1.0))
        cov = F.abs(F.coalesce(one(F.col("d") * (F.col("y") - F.col("nu")) * (F.col("y2") - F.col("nu"))), F.lit(0.0)) / sd)
        var = one(F.col("w") * F.pow(F.col("y") - F.col("nu"), 2)) / one("w")
        out = t.groupBy("seq_id").agg(
            F.first("nu").alias("nu"), F.greatest(cov if mode == "cov" else var, F.lit(1e-12)).alias("rho2"),
            F.greatest(F.coalesce(one(F.col("d") * F.pow(F.col("y2") - F.col("y"), 2)), F.lit(0.0)) / (2 * sd), F.lit(1e-12)).alias("sigma2"),
        )
    elif name == "poisson":
        m = s.groupBy("seq_id").agg((one("y") / one("w")).alias("m"), F.count(F.lit(1)).alias("n"))
        t = s.join(m, "seq_id").groupBy("seq_id").agg(F.first("m").alias("m"), F.first("n").alias("n"), (one(F.col("w") * F.pow(F.col("y") / F.greatest("w", F.lit(1e-300)) - F.col("m"), 2)) / one("w")).alias("v"))
        v = F.when(F.col("n") > 1, F.col("v")).otherwise(F.greatest(F.lit(1.0), F.col("m")))
        al = F.when(v > F.col("m") + 1e-12, F.greatest(F.lit(1e-8), F.col("m") * F.col("m") / (v - F.col("m")))).otherwise(1e6)
        out = t.select("seq_id", al.alias("alpha"), F.greatest(F.lit(1e-8), al / F.greatest("m", F.lit(1e-12))).alias("beta"))
    elif name == "logistic_normal":
        c = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("y") / F.col("n_trials")))
        s = s.withColumn("z", F.log(c / (1 - c)))
        m = s.groupBy("seq_id").agg((one(F.col("w") * F.col("z")) / one("w")).alias("nu"))
        out = s.join(m, "seq_id").groupBy("seq_id").agg(F.first("nu").alias("nu"), F.greatest(one(F.col("w") * F.pow(F.col("z") - F.col("nu"), 2)) / one("w"), F.lit(1e-6)).alias("rho2"))
    else:
        y, floor, low = F.col("y"), 1e-12, 1e-8
        p = {"binomial": y / F.greatest("n_trials", F.lit(1.0)), "negbin": F.col("r") / (F.col("r") + F.greatest(y, F.lit(0.0)) + 1e-9)}.get(name, y)
        if name == "negbin":
            floor, low = 1e-9, 1e-6
        wt = F.col("w") * F.col("n_trials") if name == "binomial" else F.col("w")
        s = s.withColumn("p", p).withColumn("wt", wt)
        m = s.groupBy("seq_id").agg((one(F.col("wt") * F.col("p")) / one("wt")).alias("mu"), F.count(F.lit(1)).alias("n"), F.avg("phi").alias("phi"))
        each = F.col("mu") * (1 - F.col("mu"))
        noise = {"binomial": each / F.greatest("n_trials", F.lit(1.0)), "bernoulli": each, "beta": each / KAPPA, "beta_obs": each / (F.col("phi") + 1), "negbin": F.lit(0.0)}[name]
        t = s.drop("phi").join(m, "seq_id").groupBy("seq_id").agg(
            F.first("mu").alias("mu"), F.first("n").alias("n"), (one(F.col("w") * F.pow(F.col("p") - F.col("mu"), 2)) / one("w")).alias("v"), (one(F.col("w") * noise) / one("w")).alias("noise")
        )
        v = F.when(F.col("n") > 1, F.col("v")).otherwise(1e-4) - F.col("noise")
        tau = F.greatest(F.lit(low), F.col("mu") * (1 - F.col("mu")) / F.greatest(v, F.lit(floor)) - 1)
        out = t.select("seq_id", F.greatest(F.col("mu") * tau, F.lit(1e-12)).alias("alpha"), F.greatest((1 - F.col("mu")) * tau, F.lit(1e-12)).alias("beta"))
    for k, v in (given or {}).items():
        out = out.withColumn(k, F.lit(float(v)))
    return out


def checked(seq: DataFrame, name: str) -> DataFrame:
    """`seq`, which fails when it is read if an observed row has a negative or non-finite weight or, for Poisson counts,
    a positive count without exposure."""
    bad = F.col("w").isNull() | F.isnan("w") | (F.col("w") < 0) | (F.col("w") == float("inf"))
    fail = F.when((F.col("a") > 0) & bad, F.raise_error(F.lit("weights must be finite and not negative")).cast("double"))
    if name == "poisson":
        at = F.concat(F.lit("positive count with zero exposure in "), F.col("seq_id"), F.lit(" at "), F.col("idx").cast("string"))
        fail = fail.when((F.col("a") > 0) & (F.col("w") == 0) & (F.col("y") > 0), F.raise_error(at).cast("double"))
    return seq.withColumn("w", fail.otherwise(F.col("w")))


def prefix(seq: DataFrame, name: str) -> DataFrame:
    """Prefix sums of the family's terms at positions 0..n: seq_id, pos, n_rows and one column p_<term> each."""
    t = FAMILIES[name][0]({c: F.col(c) for c in ROW}, cols)
    by = Window.partitionBy("seq_id").orderBy("idx")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    s = checked(seq, name).select("seq_id", "idx", *[c.alias(f"t_{k}") for k, c in t.items()])
    inner = s.select("seq_id", F.col("idx").alias("pos"), *[F.sum(f"t_{k}").over(run).alias(f"p_{k}") for k in t])
    zero = s.where("idx = 1").select("seq_id", F.lit(0).alias("pos"), *[F.lit(0.0).alias(f"p_{k}") for k in t])
    return inner.unionByName(zero)


#: Positions to a side of a tile of a long sequence's block table, at least; tiles of a sequence, at most.
TILE, TILES = 512, 32


def tiles(p: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Prefix sums as one row a tile: seq_id, t, most (a sequence's last t), and pos and `keys` as arrays. Tiles widen with
    the sequence, so that there are never more than TILES."""
    last = F.max("pos").over(Window.partitionBy("seq_id"))
    p = p.withColumn("last", last).withColumn("width", F.greatest(F.lit(tile), F.ceil((F.col("last") + 1) / TILES)).cast("int"))
    p = p.groupBy("seq_id", F.floor(F.col("pos") / F.col("width")).cast("int").alias("t"), "width", "last").agg(F.array_sort(F.collect_list(F.struct("pos", *keys))).alias("v"))
    return p.select("seq_id", "t", "width", F.floor(F.col("last") / F.col("width")).cast("int").alias("most"), *[F.col(f"v.{c}").alias(c) for c in ("pos", *keys)])


def tiled(left: DataFrame, right: DataFrame, max_len: int | None) -> tuple[DataFrame, DataFrame]:
    """Tiles of starts and ends of blocks, each repeated for every pair (ti, tj) that it belongs to, and dealt out by pair:
    a sequence's blocks are made by all tasks, not by one. A tile is repeated TILES + 1 times in all, so what is shuffled
    grows with the rows."""
    sc = left.sparkSession.sparkContext
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16 * sc.defaultParallelism)
    far = F.ceil(F.lit(max_len) / F.col("width")).cast("int") if max_len else F.col("most")  # tiles that a block reaches
    left = left.withColumn("ti", F.col("t")).withColumn("tj", F.explode(F.sequence("t", F.least("most", F.col("t") + far))))
    right = right.withColumn("tj", F.col("t")).withColumn("ti", F.explode(F.sequence(F.greatest(F.lit(0), F.col("t") - far), "t")))
    left, right = left.drop("t", "width", "most"), right.drop("t", "width", "most")
    keys = ["seq_id", "ti", "tj"]
    return left.repartition(parts, *keys), right.repartition(parts, *keys)


def _prior_once(evidence, names: tuple, hyper_df: DataFrame) -> tuple[tuple, DataFrame]:
    """The constant of a beta prior once a sequence, not once a block."""
    if evidence is not _beta_update:
        return names, hyper_df
    return (*names, "log_prior"), hyper_df.withColumn("log_prior", cols.lnbeta(F.col("alpha"), F.col("beta")))


def gathered(seq: DataFrame, name: str, hyper_df: DataFrame, min_len: int = 1, max_len: int | None = None, tile: int = TILE) -> DataFrame:
    """The block table of sequences that grow with the input, blocks that share length and sums as one row: seq_id, length,
    log_a0, a1 and starts, their i. Pairs of tiles are dealt over all tasks."""
    terms, evidence, names = FAMILIES[name]
    p = prefix(seq, name)
    keys = [c for c in p.columns if c.startswith("p_")]
    names, hyper_df = _prior_once(evidence, names, hyper_df)
    t = tiles(p, keys, tile)
    left = t.select("seq_id", "t", "width", "most", F.col("pos").alias("i"), *[F.col(c).alias(f"i_{c}") for c in keys])
    right = t.select("seq_id", "t", "width", "most", F.col("pos").alias("j"), *[F.col(c).alias(f"j_{c}") for c in keys])
    h = hyper_df.select("seq_id", *[F.col(k).cast("double").alias(f"h_{k}") for k in names])
    left, right = tiled(left, right.join(h, "seq_id"), max_len)
    run, schema = diagonals.gather(keys, [f"h_{k}" for k in names], max_len)
    g = left.join(right, ["seq_id", "ti", "tj"]).mapInArrow(run, schema)
    g = g.where((F.col("length") >= min_len) & ((F.col("length") <= max_len) if max_len else F.lit(True)))
    ev, mean = evidence({c[2:]: F.col(c) for c in keys}, {k: F.col(f"h_{k}") for k in names}, cols)
    return g.select("seq_id", "length", ev.alias("log_a0"), mean.alias("a1"), "starts")


def spread(g: DataFrame) -> DataFrame:
    """The rows of `gathered`, one a block: seq_id, i, j, log_a0, a1."""
    rows = g.select("seq_id", "length", "log_a0", "a1", F.explode("starts").alias("i"))
    return rows.select("seq_id", "i", (F.col("i") + F.col("length")).alias("j"), "log_a0", "a1")


def blocks(seq: DataFrame, name: str, hyper_df: DataFrame, min_len: int = 1, max_len: int | None = None, tile: int | None = None) -> DataFrame:
    """The block table: seq_id, i, j, log_a0 (log evidence of rows i+1..j) and a1 (posterior mean). Pairs come from an
    equi-join on the sequence with i < j as residual; inadmissible lengths are never made. The hyperparameters join
    first, so one shuffle by sequence serves both sides. With `tile`, for sequences that grow with the input, pairs come
    from tiles of so many positions to a side, or more (`gathered`)."""
    if tile:
        return spread(gathered(seq, name, hyper_df, min_len, max_len, tile))
    terms, evidence, names = FAMILIES[name]
    p = prefix(seq, name)
    keys = [c for c in p.columns if c.startswith("p_")]
    left = p.select("seq_id", F.col("pos").alias("i"), *[F.col(c).alias(f"i_{c}") for c in keys])
    names, hyper_df = _prior_once(evidence, names, hyper_df)
    right = p.select("seq_id", F.col("pos").alias("j"), *[F.col(c).alias(f"j_{c}") for c in keys]).join(hyper_df, "seq_id")
    fits = (F.col("j") - F.col("i") >= min_len) & ((F.col("j") - F.col("i") <= max_len) if max_len else F.lit(True))
    b = {c[2:]: F.col(f"j_{c}") - F.col(f"i_{c}") for c in keys}
    ev, mean = evidence(b, {k: F.col(k) for k in names}, cols)
    return left.join(right, "seq_id").where(fits).select("seq_id", "i", "j", ev.alias("log_a0"), mean.alias("a1"))
