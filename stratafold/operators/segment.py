"""Segmentation of many sequences at once: block tables to posteriors, boundaries, segments and curves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import arrays
from . import dp, families, prior, tiled

RESULT = (
    "seq_id string, n int, k_max int, k_map int, log_evidence double, log_joint_map double, log_c array<double>, log_left_n array<double>, log_right_0 array<double>, "
    "log_post array<double>, log_p array<double>, boundaries array<int>, means array<double>, marginal array<double>, marginal_mixed array<double>, "
    "location array<array<double>>, curve_fixed array<double>, curve_mixed array<double>, error string"
)


#: Rows up to which a fit keeps dense tables, squares of this; longer sequences go through tiles. Rows that are taken at
#: most: tiles take time that grows with the square (50,000 rows and 6 segments: see README), families without closed
#: form always keep dense tables (about 100 n^2 bytes).
DENSE, LONGEST, LONGEST_QUADRATURE = 1024, 65_536, 3072


def arrow_type(name: str):
    """The Arrow type of a column of `RESULT`."""
    import pyarrow as pa

    plain = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    return plain[name] if name in plain else pa.list_(arrow_type(name[len("array<") : -1]))


def by_sequence(rows: DataFrame, columns: list[str], one, schema: str) -> DataFrame:
    """`one(seq_id, columns as a frame)` for every sequence, rows in order of idx: one shuffle, then Arrow batches are cut
    where the sequence changes; a dictionary per sequence comes back."""
    import pyarrow as pa

    kinds = pa.schema([(name, arrow_type(kind)) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches):
        key, held, out = None, [], []

        def close():
            out.append(one(key, pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in columns})))

        for b in batches:
            if not b.num_rows:
                continue
            ids = np.array(b.column("seq_id").to_pylist(), object)
            data = {c: b.column(c).to_numpy(zero_copy_only=False) for c in columns}
            at = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if held and ids[lo] != key:
                    close()
                    held = []
                key = ids[lo]
                held.append({c: v[lo:hi] for c, v in data.items()})
            if len(out) >= 64:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out = []
        if held:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return rows.select("seq_id", "idx", *columns).repartition("seq_id").sortWithinPartitions("seq_id", "idx").mapInArrow(run, schema)


def solve(seq_id: str, s: np.ndarray, mean: np.ndarray, g: np.ndarray | None, k_max: int, count, curves: bool = True, k: int | None = None) -> dict:
    """Everything about one sequence from dense tables of scores, means and (if not uniform) prior factors."""
    n = len(s) - 1
    k_max = min(k_max, n)
    row = dict.fromkeys(c.split()[0] for c in RESULT.split(", ")) | {"seq_id": seq_id, "n": n, "k_max": k_max}
    left, right = dp.forward(s, k_max), dp.backward(s, k_max)
    log_c = dp.log_normaliser(n, k_max, g)
    log_p = prior.count_prior(count, k_max)
    try:
        post, z = dp.posterior_k(left, log_c, log_p)
    except ValueError as e:
        return row | {"error": str(e)}
    k_map = k or int(post.argmax()) + 1
    best, back = dp.best_paths(s, k_map)
    cut = dp.backtrack(back, k_map, n)
    fixed = np.zeros(k_max)
    fixed[k_map - 1] = 1.0
    mixed = sum(np.exp(post[q - 1]) * dp.marginals(left, right, q) for q in range(2, k_max + 1) if np.isfinite(post[q - 1]))
    return row | {
        "k_map": k_map, "log_evidence": z, "log_joint_map": float(best[k_map, n]), "log_c": log_c, "log_left_n": left[1:, n], "log_right_0": right[1:, 0], "log_post": post, "log_p": log_p,
        "boundaries": cut, "means": [float(mean[a, b]) for a, b in zip(cut[:-1], cut[1:], strict=True)],
        "marginal": dp.marginals(left, right, k_map), "marginal_mixed": mixed + np.zeros(n + 1), "location": [x.tolist() for x in dp.locations(left, right, k_map)],
        "curve_fixed": dp.curve(s, mean, left, right, fixed) if curves else None, "curve_mixed": dp.curve(s, mean, left, right, np.exp(post)) if curves else None,
    }


def dense(pdf: pd.DataFrame, value: str, n: int) -> np.ndarray:
    out = np.full((n + 1, n + 1), -np.inf)
    out[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf[value].to_numpy()
    return out


def family_tables(pdf: pd.DataFrame, name: str, h: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Dense (log evidence, mean) of one sequence's rows: prefix sums and their outer differences."""
    if name in ("beta_obs", "logistic_normal"):
        from . import quadrature

        return quadrature.tables(pdf, name, h)
    terms, evidence, _ = families.FAMILIES[name]
    t = terms({c: pdf[c].to_numpy(float) for c in families.ROW}, arrays)
    b = {k: np.concatenate([[0.0], np.cumsum(v)]) for k, v in t.items()}
    n = len(pdf)
    i, j = np.triu_indices(n + 1, 1)
    ev, mean = evidence({k: v[j] - v[i] for k, v in b.items()}, h, arrays)
    out = np.full((2, n + 1, n + 1), -np.inf)
    out[0, i, j], out[1, i, j] = ev, mean
    return out[0], out[1]


@dataclass(frozen=True)
class Fit:
    """Fitted sequences: `rows` has one row per sequence; the properties are its long tables."""

    rows: DataFrame

    def is_fitted(self) -> bool:
        """Whether the table has every column of a fit."""
        return {c.split()[0] for c in RESULT.split(", ")} <= set(self.rows.columns)

    @property
    def posterior_k(self) -> DataFrame:
        z = F.arrays_zip("log_c", "log_left_n", "log_post")
        p = self.rows.select("seq_id", F.posexplode(z).alias("k", "p"))
        return p.select("seq_id", (F.col("k") + 1).alias("k"), F.col("p.log_c").alias("log_c"), (F.col("p.log_left_n") - F.col("p.log_c")).alias("log_py_k"), F.col("p.log_post").alias("log_post"), F.exp("p.log_post").alias("post"))

    def _positions(self, column: str, name: str) -> DataFrame:
        return self.rows.select("seq_id", "n", "k_map", F.posexplode(column).alias("pos", name)).where("pos > 0 and pos < n").drop("n")

    @property
    def boundary_marginal(self) -> DataFrame:
        return self._positions("marginal", "p")

    @property
    def boundary_marginal_mixed(self) -> DataFrame:
        return self._positions("marginal_mixed", "p").drop("k_map")

    @property
    def count_prior(self) -> DataFrame:
        """The count prior that the fit was made under: seq_id, k, log_p."""
        return self.rows.select("seq_id", F.posexplode("log_p").alias("k", "log_p")).select("seq_id", (F.col("k") + 1).alias("k"), "log_p")

    def under(self, count) -> DataFrame:
        """seq_id, k, log_post, log_evidence under another count prior (a name, a rate, a function of k; None for that of the
        fit), from what the fit kept: no recursion runs again."""
        most = self.rows.agg(F.max("k_max")).first()[0] or 1
        t = self.rows.select("seq_id", "log_p", F.posexplode(F.arrays_zip("log_c", "log_left_n")).alias("k", "p"))
        if count is None:
            new = F.get("log_p", F.col("k"))
        else:  # one prior per number of terms, as sequences shorter than k_max have fewer
            new = F.get(F.get(F.array(*[F.array(*[F.lit(float(v)) for v in prior.count_prior(count, m)]) for m in range(1, most + 1)]), F.size("log_p") - 1), F.col("k"))
        no = F.lit(float("-inf"))
        t = t.select("seq_id", (F.col("k") + 1).alias("k"), F.when(F.col("p.log_c") > no, F.col("p.log_left_n") - F.col("p.log_c") + new).otherwise(no).alias("v"))
        by = Window.partitionBy("seq_id")
        top = F.max("v").over(by)
        t = t.withColumn("top", top)
        t = t.withColumn("log_evidence", F.col("top") + F.log(F.sum(F.exp(F.col("v") - F.col("top"))).over(by)))
        return t.select("seq_id", "k", (F.col("v") - F.col("log_evidence")).alias("log_post"), "log_evidence")

    @property
    def boundary_location(self) -> DataFrame:
        p = self.rows.select("seq_id", "k_map", F.posexplode("location").alias("b", "at")).select("seq_id", "k_map", (F.col("b") + 1).alias("boundary"), F.posexplode("at").alias("pos", "p"))
        return p.where("p > 0")

    @property
    def segment(self) -> DataFrame:
        s = self.rows.select("seq_id", "boundaries", F.posexplode("means").alias("q", "mean"))
        return s.select("seq_id", (F.col("q") + 1).alias("q"), F.get("boundaries", F.col("q")).alias("i"), F.get("boundaries", F.col("q") + 1).alias("j"), "mean")

    @property
    def curve(self) -> DataFrame:
        c = self.rows.select("seq_id", F.posexplode(F.arrays_zip("curve_fixed", "curve_mixed")).alias("at", "c"))
        return c.select("seq_id", (F.col("at") + 1).alias("idx"), F.col("c.curve_fixed").alias("bayes_fixed"), F.col("c.curve_mixed").alias("bayes_mixed"))

    @property
    def map_curve(self) -> DataFrame:
        return self.segment.select("seq_id", F.explode(F.sequence(F.col("i") + 1, F.col("j"))).alias("idx"), "mean")

    @property
    def summary(self) -> DataFrame:
        return self.rows.select("seq_id", "n", "k_max", "k_map", "log_evidence", "log_joint_map", (F.exp(F.element_at("log_post", -1))).alias("p_k_max"))

    @property
    def modes(self) -> DataFrame:
        by = Window.partitionBy("seq_id").orderBy(F.desc("p"), "pos")
        return self.boundary_marginal.withColumn("rk", F.row_number().over(by)).where("rk < k_map").select("seq_id", "pos", "p")


def fit_blocks(block: DataFrame, k_max: int, count=None, value: str = "log_a0", mean: str = "a1", k: int | None = None, curves: bool = True) -> Fit:
    """Fits from a block table (seq_id, i, j, log_a0, a1 and, for a partition prior, log_g)."""
    has_g = "log_g" in block.columns

    def run(key, pdf):
        n = int(pdf["j"].max())
        g = dense(pdf, "log_g", n) if has_g else None
        if g is not None and (g[np.triu_indices(n + 1, 1)] == 0).all():
            g = None
        s = dense(pdf, value, n)
        return pd.DataFrame([solve(key[0], s if g is None else s + g, dense(pdf, mean, n), g, k_max, count, curves, k)])

    return Fit(block.groupBy("seq_id").applyInPandas(run, RESULT))


def block_source(pdf: pd.DataFrame, name: str, h: dict[str, float], factor=None) -> tiled.Blocks:
    """The prefix sums of one sequence's rows, from which tiles make block scores."""
    terms, evidence, _ = families.FAMILIES[name]
    t = terms({c: pdf[c].to_numpy(float) for c in families.ROW}, arrays)
    return tiled.Blocks({k: np.concatenate([[0.0], np.cumsum(v)]) for k, v in t.items()}, evidence, h, factor)


def axis(x: np.ndarray) -> np.ndarray:
    """Boundary coordinates at positions 0..n, as `sources.sequences.bounds` has them."""
    mid = (x[1:] + x[:-1]) / 2
    first, last = ((x[1] - x[0]) / 2, (x[-1] - x[-2]) / 2) if len(x) > 1 else (0.5, 0.5)
    return np.concatenate([[x[0] - first], mid, [x[-1] + last]])


def length_factor(min_len: int = 1, span=None, u: np.ndarray | None = None):
    """The log prior factor of blocks as a function of index arrays (i, j): -inf below `min_len` rows, plus
    `span(length of the block, namespace)`, its length on the axis of boundaries u, or in rows without u; what is not
    finite there counts as not allowed. None without either."""
    if min_len <= 1 and span is None:
        return None

    def factor(i, j):
        d = np.abs(j - i)
        g = np.where(d >= min_len, 0.0, -np.inf)
        if span is None:
            return g
        with np.errstate(divide="ignore", invalid="ignore"):
            f = span(np.abs(u[j] - u[i]) if u is not None else d.astype(float), arrays)
            return np.where((d > 0) & np.isfinite(f), g + f, np.where(d > 0, -np.inf, g))

    return factor


def segment(
    seq: DataFrame, name: str, k_max: int, hyper_df: DataFrame | None = None, count=None, k: int | None = None, curves: bool = True, min_len: int = 1, span=None,
    on_axis: bool = False, dense_rows: int = DENSE,
) -> Fit:
    """Full fit of every sequence of `seq` (completed): hyperparameters by grouped aggregates, then one kernel per
    sequence, so the only shuffles are by sequence and no block ever becomes a row. `span(length, ns)` gives the
    log prior factor of a block from its length in rows, or `on_axis` on the axis x; it is written against a namespace of
    functions (ns.ln, ns.where, ...) like the families, so the same function serves Columns (`prior.Partition(span=...)`)
    and this kernel. Where it is not finite a block is not allowed; the normaliser follows it."""
    h = families.hyper(seq, name) if hyper_df is None else hyper_df
    names = families.FAMILIES[name][2] if name in families.FAMILIES else {"beta_obs": ("alpha", "beta"), "logistic_normal": ("nu", "rho2")}[name]
    rows = seq.join(h.select("seq_id", *[F.col(x).alias(f"h_{x}") for x in names]), "seq_id")

    most = LONGEST if name in families.FAMILIES else LONGEST_QUADRATURE

    def run(key, pdf):
        n, given = len(pdf), {x: float(pdf[f"h_{x}"].iloc[0]) for x in names}
        factor = length_factor(min_len, span, axis(pdf["x"].to_numpy(float)) if on_axis else None)
        if n > most:
            raise ValueError(f"sequence {key!r} has {n} rows: beyond {most} use sliding windows")
        if n > dense_rows and name in families.FAMILIES:
            row = dict.fromkeys(c.split()[0] for c in RESULT.split(", ")) | {"seq_id": key, "n": n, "k_max": min(k_max, n)}
            return tiled.solve(row, block_source(pdf, name, given, factor), k_max, count, curves, k)
        s, mean = family_tables(pdf, name, given)
        g = None
        if factor:
            i, j = np.indices((n + 1, n + 1))
            g = np.where(i < j, factor(i, j), -np.inf)
            s = s + g
        return solve(key, s, mean, g, k_max, count, curves, k)

    more = ["x"] if on_axis else []
    return Fit(by_sequence(families.checked(rows, name), [*families.ROW, *more, *[f"h_{x}" for x in names]], run, RESULT))


def renewal(seq: DataFrame, name: str, k_max: int, rate: float, power: float, hyper_df: DataFrame | None = None) -> Fit:
    """A fit under a geometric number of changes, p(k) ~ (1 - rate)^(k - 1) rate, and segment factors span^power."""
    from ..sources.sequences import bounds

    h = families.hyper(seq, name) if hyper_df is None else hyper_df
    b = prior.with_prior(families.blocks(seq, name, h), bounds(seq), prior.Partition(cohesion="span", power=power))
    return fit_blocks(b, k_max, lambda k: (1 - rate) ** (k - 1) * rate)


def null_comparison(seq: DataFrame, name: str, k_max: int, low: float, high: float, hyper_df: DataFrame | None = None) -> DataFrame:
    """Mean held-out log density of the fit and of a single segment, on the rows between round(low n) and round(high n):
    seq_id, fitted, single, gain."""
    from . import metrics, predict

    h = metrics.holdout(seq, low, high)
    train = h.withColumn("a", F.when(F.col("held"), 0.0).otherwise(F.col("a"))).drop("held")
    held = h.where("held").select("seq_id", "x", "y", "w", "n_trials", "r")
    hyp = families.hyper(train, name) if hyper_df is None else hyper_df
    one = lambda k: predict.score_points(train, name, segment(train, name, k, hyp, curves=False).segment, hyp, held).groupBy("seq_id").agg(F.avg("log_density").alias("v"))
    t = one(k_max).withColumnRenamed("v", "fitted").join(one(1).withColumnRenamed("v", "single"), "seq_id")
    return t.withColumn("gain", F.col("fitted") - F.col("single"))
