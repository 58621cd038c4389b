"""Families without a closed form: beta observations with known precision, and logistic-normal success rates.

Block tables come from node sums or from iterations that run over all blocks of a sequence at once, inside the kernel of
that sequence. `node_blocks` gives the same values as DataFrame operations (node table joined before the sums).
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import arrays, cols, lse

NODES, GH_NODES, MOST_STEPS = 32, 40, 60
#: Blocks that an iteration holds at once, and rows that a sweep of expectation propagation takes at most (its tables hold
#: n^2 / 4 sites times 25 nodes).
CHUNK, LONGEST_SWEEP = 1 << 15, 1024


@functools.lru_cache(maxsize=16)
def legendre(n: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on (0, 1)."""
    x, w = np.polynomial.legendre.leggauss(n)
    return 0.5 * (x + 1), 0.5 * w


@functools.lru_cache(maxsize=16)
def hermite(n: int = GH_NODES) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.hermite.hermgauss(n)


def _beta_node_terms(y, phi, mu, ns):
    """Log density of one observation at node mean mu."""
    a, b = phi * mu, phi * (1.0 - mu)
    return ns.lgamma(phi) - ns.lgamma(a) - ns.lgamma(b) + (a - 1.0) * ns.ln(y) + (b - 1.0) * ns.ln(1.0 - y)


def _sums(v: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(v)])


def _outer(v: np.ndarray) -> np.ndarray:
    p = _sums(v)
    return p[None, :] - p[:, None]


def domain(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(power times weight, y, phi) of beta observations; hidden rows pass the domain check."""
    aw = (pdf["a"] * pdf["w"]).to_numpy(float)
    y = np.where(aw > 0, pdf["y"].to_numpy(float), 0.5)
    if ((y <= 0) | (y >= 1)).any():
        raise ValueError("beta observations lie strictly between 0 and 1")
    return aw, y, pdf["phi"].to_numpy(float)


def beta_prior(mu: np.ndarray, h: dict[str, float]) -> np.ndarray:
    """Log density of the prior at node means."""
    return (h["alpha"] - 1) * np.log(mu) + (h["beta"] - 1) * np.log1p(-mu) - float(arrays.lnbeta(np.float64(h["alpha"]), np.float64(h["beta"])))


def beta_obs(pdf: pd.DataFrame, h: dict[str, float], nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Dense (log evidence, mean); nodes are added one by one, so a handful of n x n tables is all that is held."""
    mu, wt = legendre(nodes)
    aw, y, phi = domain(pdf)
    base, n = np.log(wt) + beta_prior(mu, h), len(y)
    top, total, first = np.full((n + 1, n + 1), -np.inf), np.zeros((n + 1, n + 1)), np.zeros((n + 1, n + 1))
    for g in range(nodes):
        lw = base[g] + _outer(aw * _beta_node_terms(y, phi, mu[g], arrays))
        new = np.maximum(top, lw)
        keep, one = np.exp(top - new), np.exp(lw - new)
        total, first, top = total * keep + one, first * keep + mu[g] * one, new
    return top + np.log(total), first / total


def gh(s, n, nu: float, rho2: float, nodes: int = GH_NODES) -> tuple[np.ndarray, np.ndarray]:
    """(log evidence, E[sigmoid]) of counts s of n by Gauss-Hermite quadrature."""
    x, w = hermite(nodes)
    theta = nu + math.sqrt(2 * rho2) * x
    lw = np.log(w)[:, None] + s[None] * theta[:, None] - n[None] * arrays.softplus(theta)[:, None] - 0.5 * math.log(math.pi)
    ev = lse(lw, axis=0)
    return ev, (np.exp(lw - ev) * arrays.sigmoid(theta)[:, None]).sum(axis=0)


def mackay(m, v):
    """E[sigmoid] of a normal, by the probit-matched scale."""
    return arrays.sigmoid(m / np.sqrt(1 + math.pi * v / 8))


def laplace(s, n, nu: float, rho2: float):
    """(log evidence, mean, |gradient|, remainder estimate) by Newton steps on all blocks at once."""
    goal = lambda t: s * t - n * arrays.softplus(t) - (t - nu) ** 2 / (2 * rho2)
    t = np.full(np.shape(s), float(nu))
    for _ in range(MOST_STEPS):
        q = arrays.sigmoid(t)
        step = (s - n * q - (t - nu) / rho2) / (n * q * (1 - q) + 1 / rho2)
        for _ in range(30):  # halved wherever a full step would lower the concave objective
            worse = goal(t + step) < goal(t) - 1e-12
            if not worse.any():
                break
            step = np.where(worse, step / 2, step)
        t = t + step
        if np.abs(step).max(initial=0) < 1e-10:
            break
    q = arrays.sigmoid(t)
    hess = n * q * (1 - q) + 1 / rho2
    v = 1 / hess
    ev = s * t - n * arrays.softplus(t) - (t - nu) ** 2 / (2 * rho2) - 0.5 * np.log(2 * math.pi * rho2) + 0.5 * math.log(2 * math.pi) - 0.5 * np.log(hess)
    d = q * (1 - q)
    h3, h4 = n * d * (1 - 2 * q), n * d * (1 - 6 * d)
    return ev, mackay(t, v), np.abs(s - n * q - (t - nu) / rho2), v**2 * np.abs(h4) / 8 + 5 / 24 * v**3 * h3**2


def lam(xi):
    """tanh(xi / 2) / (4 xi), 1/8 at zero."""
    small = np.abs(xi) < 1e-10
    return np.where(small, 0.125, np.tanh(xi / 2) / (4 * np.where(small, 1.0, xi)))


def jaakkola(s, n, nu: float, rho2: float):
    """(lower bound, mean, gap) of the variational tangent bound at its fixed point; the gap is the expected slack of the
    bound under the variational posterior (a diagnostic)."""
    xi = np.full(np.shape(s), 1.0)
    for _ in range(200):
        v = 1 / (1 / rho2 + 2 * n * lam(xi))
        m = v * (s - n / 2 + nu / rho2)
        new = np.sqrt(m * m + v)
        done = np.abs(new - xi).max(initial=0) < 1e-12
        xi = new
        if done:
            break
    v = 1 / (1 / rho2 + 2 * n * lam(xi))
    m = v * (s - n / 2 + nu / rho2)
    ev = 0.5 * np.log(v / rho2) + 0.5 * (m * m / v - nu * nu / rho2) + n * (np.log(arrays.sigmoid(xi)) - xi / 2 + lam(xi) * xi * xi)
    x, w = hermite(60)
    theta = m[None] + np.sqrt(2 * v)[None] * x[:, None]
    tangent = (theta - xi[None]) / 2 + lam(xi)[None] * (theta**2 - xi[None] ** 2) + np.log1p(np.exp(xi))[None]
    gap = n * (w[:, None] * (tangent - arrays.softplus(theta))).sum(axis=0) / math.sqrt(math.pi)
    return ev, mackay(m, v), gap


def expectation(y: np.ndarray, n: np.ndarray, nu: float, rho2: float, damping: float = 0.7, most: int = 60) -> tuple[float, float]:
    """(log evidence, mean) of one block by expectation propagation over its observations (y of n each), parallel damped
    updates; the site normalisers carry the mean terms."""
    x, w = hermite(25)
    k = len(y)
    tau, eta, lz = np.zeros(k), np.zeros(k), np.zeros(k)
    for _ in range(most):
        tv, te = 1 / rho2 + tau.sum(), nu / rho2 + eta.sum()
        cv = 1 / np.maximum(tv - tau, 1e-10)
        cm = cv * (te - eta)
        theta = cm[:, None] + np.sqrt(2 * cv)[:, None] * x[None]
        lw = np.log(w / math.sqrt(math.pi))[None] + y[:, None] * theta - n[:, None] * arrays.softplus(theta)
        z = lse(lw, axis=1)
        pw = np.exp(lw - z[:, None])
        m = (pw * theta).sum(axis=1)
        v = np.maximum((pw * theta**2).sum(axis=1) - m**2, 1e-12)
        nt, ne = 1 / v - 1 / cv, m / v - cm / cv
        change = max(np.abs(nt - tau).max(), np.abs(ne - eta).max())
        tau, eta = tau + damping * (nt - tau), eta + damping * (ne - eta)
        lz = z + 0.5 * np.log(cv / v) + 0.5 * (cm**2 / cv - m**2 / v)
        if change < 1e-6:
            break
    tv, te = 1 / rho2 + tau.sum(), nu / rho2 + eta.sum()
    ev = lz.sum() + 0.5 * (np.log(1 / tv) - math.log(rho2)) + 0.5 * (te**2 / tv - nu**2 / rho2)
    return float(ev), float(mackay(te / tv, 1 / tv))


def sweep(y: np.ndarray, n: np.ndarray, nu: float, rho2: float, damping: float = 0.7, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Dense (log evidence, mean) by expectation propagation: blocks of equal length advance together, each from the
    sites of the block that lacks its last row, until all have settled."""
    size = len(y)
    out = np.full((2, size + 1, size + 1), -np.inf)
    x, w = hermite(25)
    log_w = np.log(w / math.sqrt(math.pi))
    tau, eta = np.zeros((size + 1, 0)), np.zeros((size + 1, 0))
    for m in range(1, size + 1):
        rows = np.arange(size - m + 1)[:, None] + np.arange(m)
        tau, eta = (np.pad(a[: len(rows)], ((0, 0), (0, 1))) for a in (tau, eta))
        ys, ns, z = y[rows], n[rows], np.zeros(rows.shape)
        live = np.arange(len(rows))
        for _ in range(most):
            t, e = tau[live], eta[live]
            tv, te = 1 / rho2 + t.sum(axis=1, keepdims=True), nu / rho2 + e.sum(axis=1, keepdims=True)
            cv = 1 / np.maximum(tv - t, 1e-10)
            cm = cv * (te - e)
            theta = cm[..., None] + np.sqrt(2 * cv)[..., None] * x
            lw = log_w + ys[live][..., None] * theta - ns[live][..., None] * arrays.softplus(theta)
            lz = lse(lw, axis=2)
            pw = np.exp(lw - lz[..., None])
            mean = (pw * theta).sum(axis=2)
            v = np.maximum((pw * theta**2).sum(axis=2) - mean**2, 1e-12)
            nt, ne = 1 / v - 1 / cv, mean / v - cm / cv
            change = np.maximum(np.abs(nt - t), np.abs(ne - e)).max(axis=1)
            tau[live], eta[live] = t + damping * (nt - t), e + damping * (ne - e)
            z[live] = lz + 0.5 * np.log(cv / v) + 0.5 * (cm**2 / cv - mean**2 / v)
            live = live[change >= 1e-6]
            if not len(live):
                break
        tv, te = 1 / rho2 + tau.sum(axis=1), nu / rho2 + eta.sum(axis=1)
        out[0, rows[:, 0], rows[:, 0] + m] = z.sum(axis=1) - 0.5 * np.log(tv * rho2) + 0.5 * (te**2 / tv - nu**2 / rho2)
        out[1, rows[:, 0], rows[:, 0] + m] = mackay(te / tv, 1 / tv)
    return out[0], out[1]


STATUS = ("ok", "not_converged", "not_finite")


def checked_integrals(value: np.ndarray, error: np.ndarray, converged: np.ndarray) -> np.ndarray:
    """The status of each integral; errors must be finite and not negative where the value is finite. A value that is not
    finite is reported as such, never as ok."""
    finite = np.isfinite(value)
    if not (np.isfinite(error[finite]) & (error[finite] >= 0)).all():
        raise ValueError("an integration error is finite and not negative")
    return np.where(finite, np.where(converged, STATUS[0], STATUS[1]), STATUS[2])


def integrated(value, error=0.0, status: str = "ok") -> dict:
    """What an integrator of the caller's own returns, validated: a value, an error, a status."""
    if status not in STATUS:
        raise ValueError(f"unknown status {status!r}")
    if not (np.isfinite(error) and error >= 0):
        raise ValueError("an integration error is finite and not negative")
    found = checked_integrals(np.array([float(value)]), np.array([float(error)]), np.array([status == "ok"]))[0]
    return {"value": float(value), "error": float(error), "status": str(found) if found == "not_finite" else status}


def doubled(evaluate, size: int, levels: tuple[int, ...], tol: float) -> dict[str, np.ndarray]:
    """Integrals of `size` blocks by more and more nodes: `evaluate(blocks, nodes)` gives (log evidence, mean) of some
    blocks; each is done when a level changes its log evidence by `tol` or less, and only the others go on. value, mean,
    error (the last change), status, nodes."""
    value, mean, error = np.full(size, np.nan), np.full(size, np.nan), np.full(size, np.inf)
    nodes, live = np.zeros(size, np.int32), np.arange(size)
    for m in levels:
        if not len(live):
            break
        v, mu = evaluate(live, m)
        change = np.abs(v - value[live])
        value[live], mean[live], nodes[live] = v, mu, m
        if m > levels[0]:
            error[live] = change
            live = live[~(change <= tol)]
    ok = error <= tol
    error = np.where(np.isfinite(error), error, 0.0 if len(levels) < 2 else np.finfo(float).max)
    return {"value": value, "mean": mean, "error": error, "status": checked_integrals(value, error, ok), "nodes": nodes}


#: Nodes tried, and the change in log evidence that counts as none.
GH_LEVELS, LEGENDRE_LEVELS, TOLERANCE = (8, 16, 32, 64, 128), (16, 32, 64, 128, 256, 512), 1e-8


def logistic_integrals(s, n, nu: float, rho2: float, levels: tuple[int, ...] = GH_LEVELS, tol: float = TOLERANCE) -> dict[str, np.ndarray]:
    """Evidence of counts s of n by Gauss-Hermite nodes laid around each block's own mode at its own width, so that long
    blocks, whose likelihood is narrow, need no more nodes than short ones."""
    goal = lambda t, k: s[k] * t - n[k] * arrays.softplus(t) - (t - nu) ** 2 / (2 * rho2)
    mode = np.full(len(s), float(nu))
    for _ in range(200):
        q = arrays.sigmoid(mode)
        step = (s - n * q - (mode - nu) / rho2) / (n * q * (1 - q) + 1 / rho2)
        every = np.arange(len(s))
        for _ in range(40):
            worse = goal(mode + step, every) < goal(mode, every) - 1e-12
            if not worse.any():
                break
            step = np.where(worse, step / 2, step)
        mode = mode + step
        if np.abs(step).max(initial=0) < 1e-12:
            break
    q = arrays.sigmoid(mode)
    width = np.sqrt(2 / (n * q * (1 - q) + 1 / rho2))

    def evaluate(live, m):
        x, w = hermite(m)
        t = mode[live, None] + width[live, None] * x
        lw = np.log(w) + x**2 + np.log(width[live, None]) + goal(t, live[:, None]) - 0.5 * math.log(2 * math.pi * rho2)
        ev = lse(lw, axis=1)
        return ev, (np.exp(lw - ev[:, None]) * arrays.sigmoid(t)).sum(axis=1)

    return doubled(evaluate, len(s), levels, tol)


def beta_integrals(pdf: pd.DataFrame, h: dict[str, float], i: np.ndarray, j: np.ndarray, levels: tuple[int, ...] = LEGENDRE_LEVELS, tol: float = TOLERANCE) -> dict[str, np.ndarray]:
    """Evidence of the blocks (i, j] of beta observations by Gauss-Legendre nodes, doubled where they do not settle."""
    aw, y, phi = domain(pdf)

    def evaluate(live, m):
        mu, wt = legendre(m)
        p = np.array([_sums(aw * _beta_node_terms(y, phi, g, arrays)) for g in mu])
        lw = (np.log(wt) + beta_prior(mu, h))[:, None] + p[:, j[live]] - p[:, i[live]]
        ev = lse(lw, axis=0)
        return ev, (mu[:, None] * np.exp(lw - ev)).sum(axis=0)

    return doubled(evaluate, len(i), levels, tol)


def logistic(pdf: pd.DataFrame, h: dict[str, float], approx: str = "gh", nodes: int = GH_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Dense (log evidence, mean), made in chunks of blocks."""
    aw, size = (pdf["a"] * pdf["w"]).to_numpy(float), len(pdf)
    y, m = aw * pdf["y"].to_numpy(float), aw * pdf["n_trials"].to_numpy(float)
    if approx == "ep":
        if size > LONGEST_SWEEP:
            raise ValueError(f"expectation propagation takes at most {LONGEST_SWEEP} rows, not {size}")
        return sweep(y, m, h["nu"], h["rho2"])
    run = {"gh": lambda *z: gh(*z, nodes), "quadrature": lambda *z: gh(*z, max(nodes, 80)), "laplace": laplace, "jj": jaakkola, "pg_vb": jaakkola}[approx]
    s, n = _sums(y), _sums(m)
    i, j = np.triu_indices(size + 1, 1)
    out = np.full((2, size + 1, size + 1), -np.inf)
    for lo in range(0, len(i), CHUNK):
        a, b = i[lo : lo + CHUNK], j[lo : lo + CHUNK]
        out[0, a, b], out[1, a, b] = run(s[b] - s[a], n[b] - n[a], h["nu"], h["rho2"])[:2]
    return out[0], out[1]


def tables(pdf: pd.DataFrame, name: str, h: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    return beta_obs(pdf, h) if name == "beta_obs" else logistic(pdf, h)


def nodes_of(kind: str, number: int):
    """The quadrature nodes as a literal array of (g, node, wt), to be exploded next to each row."""
    x, w = legendre(number) if kind == "legendre" else hermite(number)
    return F.array(*[F.struct(F.lit(g).alias("g"), F.lit(float(a)).alias("node"), F.lit(float(b)).alias("wt")) for g, (a, b) in enumerate(zip(x, w, strict=True))])


def _lse_blocks(t: DataFrame, mean) -> DataFrame:
    """log sum exp of lw over nodes per block, and the weighted mean of `mean`."""
    m = F.max("lw").over(Window.partitionBy("seq_id", "i", "j"))
    t = t.withColumn("top", m).withColumn("e", F.exp(F.col("lw") - F.col("top")))
    return t.groupBy("seq_id", "i", "j").agg((F.first("top") + F.log(F.sum("e"))).alias("log_a0"), (F.sum(F.col("e") * mean) / F.sum("e")).alias("a1"))


def node_terms(name: str):
    """(log weight and prior of a node, log density of a row at it, its mean) as Columns over node, wt and the row."""
    if name == "beta_obs":
        base = F.log("wt") + (F.col("alpha") - 1) * F.log("node") + (F.col("beta") - 1) * F.log1p(-F.col("node")) - cols.lnbeta(F.col("alpha"), F.col("beta"))
        return base, _beta_node_terms(F.col("y"), F.col("phi"), F.col("node"), cols), F.col("node")
    theta = F.col("nu") + F.sqrt(2 * F.col("rho2")) * F.col("node")
    return F.log("wt") - 0.5 * math.log(math.pi), F.col("y") * theta - F.col("n_trials") * cols.softplus(theta), cols.sigmoid(theta)


def node_blocks(seq: DataFrame, hyper: DataFrame, name: str, nodes: int) -> DataFrame:
    """Block table by quadrature as DataFrame operations; name is beta_obs or logistic_normal."""
    kind = "legendre" if name == "beta_obs" else "hermite"
    t = seq.join(hyper, "seq_id").withColumn("nd", F.explode(nodes_of(kind, nodes))).select("*", "nd.*").drop("nd")
    base, v, mean = node_terms(name)
    t = t.select("seq_id", "idx", "g", (F.col("a") * F.col("w") * v).alias("v"), base.alias("base"), mean.alias("mean"))
    run = Window.partitionBy("seq_id", "g").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    p = t.select("seq_id", "g", F.col("idx").alias("pos"), F.sum("v").over(run).alias("p"), "base", "mean")
    p = p.unionByName(t.where("idx = 1").select("seq_id", "g", F.lit(0).alias("pos"), F.lit(0.0).alias("p"), "base", "mean"))
    left = p.select("seq_id", "g", F.col("pos").alias("i"), F.col("p").alias("pi"))
    b = left.join(p.select("seq_id", "g", F.col("pos").alias("j"), F.col("p").alias("pj"), "base", "mean"), ["seq_id", "g"]).where("i < j")
    return _lse_blocks(b.withColumn("lw", F.col("base") + F.col("pj") - F.col("pi")), F.col("mean"))


def approximate_blocks(seq: DataFrame, hyper: DataFrame, approx: str) -> DataFrame:
    """Block table of the logistic-normal family by one of gh, quadrature, laplace, jj, pg_vb, ep: a kernel per sequence."""
    rows = seq.join(hyper.select("seq_id", F.col("nu").alias("h_nu"), F.col("rho2").alias("h_rho2")), "seq_id")

    def run(key, pdf):
        pdf = pdf.sort_values("idx")
        ev, mean = logistic(pdf, {"nu": float(pdf["h_nu"].iloc[0]), "rho2": float(pdf["h_rho2"].iloc[0])}, approx)
        i, j = np.triu_indices(len(pdf) + 1, 1)
        return pd.DataFrame({"seq_id": key[0], "i": i, "j": j, "log_a0": ev[i, j], "a1": mean[i, j]})

    return rows.groupBy("seq_id").applyInPandas(run, "seq_id string, i int, j int, log_a0 double, a1 double")


def integrated_blocks(seq: DataFrame, hyper: DataFrame, name: str, tol: float = TOLERANCE, levels: tuple[int, ...] | None = None, min_len: int = 1) -> DataFrame:
    """The block table of `beta_obs` or `logistic_normal` with error, status and nodes of every integral; a kernel per
    sequence, in chunks of blocks. Blocks that do not settle at the last level are reported as not_converged."""
    names = ("alpha", "beta") if name == "beta_obs" else ("nu", "rho2")
    rows = seq.join(hyper.select("seq_id", *[F.col(c).alias(f"h_{c}") for c in names]), "seq_id")

    def run(key, pdf):
        pdf = pdf.sort_values("idx")
        h = {c: float(pdf[f"h_{c}"].iloc[0]) for c in names}
        aw = (pdf["a"] * pdf["w"]).to_numpy(float)
        s, n = _sums(aw * pdf["y"].to_numpy(float)), _sums(aw * pdf["n_trials"].to_numpy(float))
        i, j = np.triu_indices(len(pdf) + 1, min_len)
        out = []
        for lo in range(0, len(i), CHUNK):
            a, b = i[lo : lo + CHUNK], j[lo : lo + CHUNK]
            r = beta_integrals(pdf, h, a, b, levels or LEGENDRE_LEVELS, tol) if name == "beta_obs" else logistic_integrals(s[b] - s[a], n[b] - n[a], h["nu"], h["rho2"], levels or GH_LEVELS, tol)
            out.append(pd.DataFrame({"seq_id": key[0], "i": a, "j": b, "log_a0": r["value"], "a1": r["mean"], "error": r["error"], "status": r["status"], "nodes": r["nodes"]}))
        return pd.concat(out)

    return rows.groupBy("seq_id").applyInPandas(run, "seq_id string, i int, j int, log_a0 double, a1 double, error double, status string, nodes int")
