"""Doubled nodes against fine grids, and what their status says."""

import math

import numpy as np
import pandas as pd
import pytest

from stratafold.operators import quadrature


def grid_evidence(s, n, nu, rho2):
    """Simpson's rule around the mode, on a grid far finer than the likelihood's width."""
    t = np.linspace(-40, 40, 400_001)
    f = s * t - n * np.logaddexp(0, t) - (t - nu) ** 2 / (2 * rho2) - 0.5 * math.log(2 * math.pi * rho2)
    top = f.max()
    w = np.ones(len(t))
    w[1:-1:2], w[2:-1:2] = 4, 2
    e = w * np.exp(f - top)
    return top + math.log(e.sum() * (t[1] - t[0]) / 3), (e / (1 + np.exp(-t))).sum() / e.sum()


def test_logistic_integrals_of_short_and_long_blocks():
    s, n = np.array([0.0, 3, 5, 0, 40, 700, 20_000, 99_999]), np.array([1.0, 3, 9, 50, 90, 1500, 100_000, 100_000])
    r = quadrature.logistic_integrals(s, n, -0.5, 2.0)
    assert set(r["status"]) == {"ok"} and (r["nodes"] <= 128).all()
    for k in range(len(s)):
        ev, mean = grid_evidence(s[k], n[k], -0.5, 2.0)
        assert abs(r["value"][k] - ev) < 1e-7 and abs(r["mean"][k] - mean) < 1e-7
    fixed = quadrature.gh(s[-2:], n[-2:], -0.5, 2.0, 40)[0]
    assert np.abs(fixed - r["value"][-2:]).max() > 1  # nodes at the prior's width miss a narrow likelihood


def test_not_converged_and_not_finite():
    r = quadrature.logistic_integrals(np.array([3.0]), np.array([7.0]), 0.0, 1.0, (2, 3), 1e-14)
    assert r["status"][0] == "not_converged" and r["error"][0] > 1e-14
    r = quadrature.doubled(lambda live, m: (np.where(live == 1, np.nan, 1.0 / m), np.zeros(len(live))), 3, (4, 8), 1e-3)
    assert r["status"].tolist() == ["not_converged", "not_finite", "not_converged"]
    r = quadrature.doubled(lambda live, m: (np.full(len(live), 2.0), np.zeros(len(live))), 3, (4, 8, 16), 0.0)
    assert r["status"].tolist() == ["ok"] * 3 and r["nodes"].tolist() == [8] * 3 and r["error"].tolist() == [0] * 3
    assert quadrature.doubled(lambda live, m: (live * 1.0, live * 1.0), 0, (4, 8), 0.0)["value"].shape == (0,)
    with pytest.raises(ValueError):
        quadrature.checked_integrals(np.array([1.0]), np.array([-1.0]), np.array([True]))
    assert quadrature.integrated(1.0, 0.5, "not_converged")["status"] == "not_converged" and quadrature.integrated(math.inf)["status"] == "not_finite"


def test_beta_integrals():
    rng = np.random.default_rng(0)
    n = 60
    pdf = pd.DataFrame({"y": rng.beta(3, 5, n), "w": 1.0, "a": 1.0, "phi": 30.0})
    h = {"alpha": 2.0, "beta": 3.0}
    i, j = np.triu_indices(n + 1, 1)
    r = quadrature.beta_integrals(pdf, h, i, j)
    assert set(r["status"]) == {"ok"} and len(set(r["nodes"].tolist())) > 1  # long blocks took more nodes than short ones
    ev, mean = quadrature.beta_obs(pdf, h, 400)
    assert np.abs(r["value"] - ev[i, j]).max() < 1e-7 and np.abs(r["mean"] - mean[i, j]).max() < 1e-7
    few = quadrature.beta_integrals(pdf, h, np.array([0]), np.array([n]), levels=(4, 6), tol=1e-8)
    assert few["status"][0] == "not_converged"
    with pytest.raises(ValueError, match="strictly between"):
        quadrature.beta_integrals(pdf.assign(y=1.0), h, i, j)


def test_sweep_has_a_limit():
    pdf = pd.DataFrame({"y": np.zeros(1100), "n_trials": 1.0, "w": 1.0, "a": 1.0})
    with pytest.raises(ValueError, match="at most"):
        quadrature.logistic(pdf, {"nu": 0.0, "rho2": 1.0}, "ep")


def test_block_table_with_status(spark):
    rng = np.random.default_rng(1)
    rows = [(s, k + 1, float(rng.binomial(9, 0.3)), 9.0, 1.0, 1.0, 9.0) for s in ("a", "b") for k in range(12)]
    seq = spark.createDataFrame(rows, "seq_id string, idx int, y double, n_trials double, w double, a double, phi double")
    h = spark.createDataFrame([("a", 0.0, 1.0), ("b", -1.0, 2.0)], "seq_id string, nu double, rho2 double")
    t = quadrature.integrated_blocks(seq, h, "logistic_normal").toPandas()
    assert len(t) == 2 * 78 and set(t["status"]) == {"ok"} and (t["error"] <= quadrature.TOLERANCE).all()
    gh = quadrature.approximate_blocks(seq, h, "quadrature").toPandas()
    m = t.merge(gh, on=["seq_id", "i", "j"])
    short = m[m["j"] - m["i"] <= 3]  # 80 nodes at the prior's width do for short blocks only
    assert len(m) == len(t) and np.abs(short["log_a0_x"] - short["log_a0_y"]).max() < 1e-4
    for r in t.sample(15, random_state=0).itertuples():
        s = sum(x[2] for x in rows if x[0] == r.seq_id and r.i < x[1] <= r.j)
        assert abs(grid_evidence(s, 9.0 * (r.j - r.i), *{"a": (0.0, 1.0), "b": (-1.0, 2.0)}[r.seq_id])[0] - r.log_a0) < 1e-7
