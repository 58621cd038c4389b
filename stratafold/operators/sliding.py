"""Long sequences by overlapping windows, each a task: means over windows (`fit`), or one exact posterior over the
lattice of all windows' candidates (`stitched`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segment


def windows(seq: DataFrame, size: int, overlap: int) -> DataFrame:
    """Rows by window: seq_id becomes seq_id#start; starts go in steps of size - overlap, the last window ends the
    sequence. Each row is in at most ceil(size / step) + 1 windows."""
    step = size - overlap
    n = seq.groupBy("seq_id").agg(F.max("idx").alias("n"))
    last = F.greatest(F.lit(0), F.col("n") - size)
    t = seq.join(n, "seq_id").withColumn("grid", F.sequence(F.greatest(F.lit(0), F.floor((F.col("idx") - size) / step).cast("int")), F.floor((F.col("idx") - 1) / step).cast("int")))
    t = t.withColumn("starts", F.array_distinct(F.transform("grid", lambda g: F.least(g * step, last).cast("int"))))
    t = t.withColumn("start", F.explode(F.array_distinct(F.array_append("starts", last.cast("int"))))).where((F.col("idx") > F.col("start")) & (F.col("idx") <= F.col("start") + size))
    return t.withColumn("seq_id", F.concat_ws("#", "seq_id", F.col("start").cast("string"))).withColumn("idx", F.col("idx") - F.col("start")).drop("n", "grid", "starts")


def fit(seq: DataFrame, name: str, k_max: int, size: int, overlap: int, hyper: DataFrame | None = None) -> dict[str, DataFrame]:
    """boundaries (union over windows), curve and step (means over covering windows of the posterior mean and of the MAP
    curve), marginal (mean) and evidence (sum over
    windows, approximate because windows overlap)."""
    from .families import hyper as estimate

    w = windows(seq, size, overlap)
    if hyper is not None:
        keys = w.select("seq_id").distinct()
        h = keys.withColumn("base", F.substring_index("seq_id", "#", 1)).join(hyper.withColumnRenamed("seq_id", "base"), "base").drop("base")
    else:
        h = estimate(w, name)
    f = segment.segment(w, name, k_max, h)
    base, start = F.substring_index("seq_id", "#", 1).alias("seq_id"), F.substring_index("seq_id", "#", -1).cast("int")
    cut = f.segment.where("i > 0").select(base, (F.col("i") + start).alias("pos")).distinct()
    curve = f.curve.select(base, (F.col("idx") + start).alias("idx"), "bayes_mixed").groupBy("seq_id", "idx").agg(F.avg("bayes_mixed").alias("mean"), F.count(F.lit(1)).alias("windows"))
    step = f.map_curve.select(base, (F.col("idx") + start).alias("idx"), "mean").groupBy("seq_id", "idx").agg(F.avg("mean").alias("mean"))
    marg = f.boundary_marginal_mixed.select(base, (F.col("pos") + start).alias("pos"), "p").groupBy("seq_id", "pos").agg(F.avg("p").alias("p"))
    ev = f.summary.select(base, "log_evidence").groupBy("seq_id").agg(F.sum("log_evidence").alias("log_evidence"), F.count(F.lit(1)).alias("windows"))
    return {"boundaries": cut, "curve": curve, "step": step, "marginal": marg, "evidence": ev, "k_hat": cut.groupBy("seq_id").agg((F.count(F.lit(1)) + 1).alias("k_hat"))}


LATTICE = "seq_id string, n int, candidates array<int>, log_evidence double, k_map int, log_post array<double>, boundaries array<int>, means array<double>, marginal array<double>, curve array<double>, error string"


def candidates(seq: DataFrame, name: str, k_max: int, size: int, overlap: int, hyper: DataFrame, least: float = 1e-3) -> DataFrame:
    """seq_id, candidates (sorted positions with 0 and n): where some window's fit sees a boundary with probability `least`
    or more or has one in its best segmentation, and where windows begin and end."""
    w = windows(seq, size, overlap)
    base, start = F.substring_index("seq_id", "#", 1), F.substring_index("seq_id", "#", -1).cast("int")
    keys = w.select("seq_id").distinct()
    f = segment.segment(w, name, k_max, keys.withColumn("base", base).join(hyper.withColumnRenamed("seq_id", "base"), "base").drop("base"), curves=False)
    at = f.boundary_marginal_mixed.where(F.col("p") >= least).select("seq_id", "pos")
    cut = f.rows.select("seq_id", F.explode("boundaries").alias("pos"))  # the ends of windows among them
    t = at.unionByName(cut).select(base.alias("seq_id"), (F.col("pos") + start).alias("pos"))
    return t.groupBy("seq_id").agg(F.array_sort(F.collect_set("pos")).alias("candidates"))


def stitched(seq: DataFrame, name: str, k_max: int, size: int, overlap: int, hyper: DataFrame, count=None, window_k: int | None = None, least: float = 1e-3) -> DataFrame:
    """One posterior of each whole sequence, exact over all partitions whose boundaries are among the windows' candidates
    (`LATTICE`: positions in rows; log_post by k; marginal and curve at the candidates and in the cells between them).

    Block scores come from prefix sums at the candidates, so nothing is averaged over windows. The prior is that of the
    whole sequence (every position could be a boundary), so log_evidence is a lower bound of the dense fit's that it
    reaches as the candidates take in all that has weight; with `least` = 0 and windows that overlap, all positions are
    candidates and the two are equal."""
    import numpy as np

    from . import dp, families, tiled

    c = candidates(seq, name, window_k or k_max, size, overlap, hyper, least)
    names = families.FAMILIES[name][2]
    rows = seq.join(hyper.select("seq_id", *[F.col(x).alias(f"h_{x}") for x in names]), "seq_id")
    # the candidates travel as marks on the rows before them
    marks = c.select("seq_id", F.explode("candidates").alias("idx")).where("idx > 0").withColumn("mark", F.lit(1.0))
    rows = families.checked(rows, name).join(marks, ["seq_id", "idx"], "left").withColumn("mark", F.coalesce("mark", F.lit(0.0)))

    def run(key, pdf):
        n = len(pdf)
        at = np.concatenate([[0], np.flatnonzero(pdf["mark"].to_numpy() > 0) + 1])
        at = at if at[-1] == n else np.append(at, n)
        whole = segment.block_source(pdf, name, {x: float(pdf[f"h_{x}"].iloc[0]) for x in names})
        b = tiled.Blocks({k: v[at] for k, v in whole.sums.items()}, whole.evidence, whole.hyper)
        most = min(k_max, len(at) - 1)
        r = tiled.solve({"error": None}, b, most, count, True, None, dp.log_normaliser(n, most, None))
        if r["error"]:
            return {"seq_id": key, "n": n, "error": r["error"]}
        return {
            "seq_id": key, "n": n, "candidates": at, "log_evidence": r["log_evidence"], "k_map": r["k_map"], "log_post": r["log_post"], "boundaries": at[np.array(r["boundaries"])], "means": r["means"],
            "marginal": r["marginal_mixed"], "curve": r["curve_mixed"],
        }

    return segment.by_sequence(rows, [*families.ROW, "mark", *[f"h_{x}" for x in names]], run, LATTICE)


def stitched_marginal(fitted: DataFrame) -> DataFrame:
    """seq_id, pos, p: boundary probabilities at the candidates inside the sequence; other positions have none."""
    t = fitted.select("seq_id", "n", F.explode(F.arrays_zip("candidates", "marginal")).alias("c")).select("seq_id", "n", F.col("c.candidates").alias("pos"), F.col("c.marginal").alias("p"))
    return t.where("pos > 0 and pos < n").drop("n")


def stitched_segment(fitted: DataFrame) -> DataFrame:
    """seq_id, q, i, j, mean of the most probable segmentation."""
    s = fitted.select("seq_id", "boundaries", F.posexplode("means").alias("q", "mean"))
    return s.select("seq_id", (F.col("q") + 1).alias("q"), F.get("boundaries", F.col("q")).alias("i"), F.get("boundaries", F.col("q") + 1).alias("j"), "mean")


def stitched_curve(fitted: DataFrame) -> DataFrame:
    """seq_id, i, j, mean: the posterior mean curve, constant between neighbouring candidates."""
    c = fitted.select("seq_id", "candidates", F.posexplode("curve").alias("k", "mean"))
    return c.select("seq_id", F.get("candidates", F.col("k")).alias("i"), F.get("candidates", F.col("k") + 1).alias("j"), "mean")


def predict(seq: DataFrame, fitted: dict[str, DataFrame], queries: DataFrame, policy: str = "error") -> DataFrame:
    """Queries (seq_id, x, ...) with `mean`: the covering windows' mean step value at the training row at or before x.
    Every training row lies in a window, so no query is left without one."""
    from .predict import locate

    return locate(seq, queries, policy).join(fitted["step"], ["seq_id", "idx"])
