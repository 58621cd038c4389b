"""Fits over tiles against dense fits, and against enumeration of all partitions."""

import itertools

import numpy as np
import pandas as pd
import pytest

from stratafold.operators import families, segment, tiled

HYPER = {"poisson": {"alpha": 1.0, "beta": 0.3}, "gaussian": {"nu": 0.0, "rho2": 4.0, "sigma2": 1.0}, "binomial": {"alpha": 1.0, "beta": 2.0}}


def rows(n, name, seed=0):
    rng = np.random.default_rng(seed)
    mu = np.repeat(rng.normal(0, 2, n // 60 + 1), 60)[:n]
    y = {"poisson": lambda: rng.poisson(np.exp(mu / 2 + 1)), "gaussian": lambda: mu + rng.normal(0, 1, n), "binomial": lambda: rng.binomial(9, 1 / (1 + np.exp(-mu)))}[name]()
    return pd.DataFrame({"y": y.astype(float), "w": 1.0, "a": (rng.random(n) > 0.1).astype(float), "n_trials": 9.0, "r": 1.0, "phi": 1.0})


def both(pdf, name, k_max, factor=None, count=None, k=None):
    n = len(pdf)
    s, mean = segment.family_tables(pdf, name, HYPER[name])
    g = None
    if factor:
        i, j = np.indices((n + 1, n + 1))
        g = np.where(i < j, factor(i, j), -np.inf)
        s = s + g
    dense = segment.solve("q", s, mean, g, k_max, count, True, k)
    empty = dict.fromkeys(dense) | {"seq_id": "q", "n": n, "k_max": min(k_max, n)}
    return dense, tiled.solve(empty, segment.block_source(pdf, name, HYPER[name], factor), k_max, count, True, k)


def same(dense, long):
    for key, want in dense.items():
        if want is None or isinstance(want, str):
            assert long[key] == want, key
            continue
        a, b = np.asarray(want, float), np.asarray(long[key], float)
        assert a.shape == b.shape and (np.isfinite(a) == np.isfinite(b)).all(), key
        ok = np.isfinite(a)
        assert np.abs(a[ok] - b[ok]).max(initial=0) <= 1e-9 * max(1.0, np.abs(a[ok]).max(initial=0)), key


@pytest.mark.parametrize("name,n,k_max", list(itertools.product(HYPER, [1, 2, 127, 129, 700], [1, 5, 20])))
def test_equals_dense(name, n, k_max):
    same(*both(rows(n, name), name, k_max))


@pytest.mark.parametrize("factor", [segment.length_factor(7), segment.length_factor(2, lambda x, ns: 1.5 * ns.ln(x / 3)), segment.length_factor(1, lambda x, ns: ns.where(x % 5 == 3, -np.inf, -0.1 * x))])
def test_equals_dense_under_length_priors(factor):
    for n in (1, 6, 20, 300):
        same(*both(rows(n, "gaussian", 3), "gaussian", 4, factor, "uniform"))
    same(*both(rows(200, "poisson", 5), "poisson", 4, factor, 0.1, k=3))


def test_sums_that_underflow_are_exact(monkeypatch):
    """Levels far apart: few segments weigh e^-thousands against the best partition."""
    pdf = rows(400, "gaussian", 7)
    pdf["y"] *= 60
    same(*both(pdf, "gaussian", 6))
    monkeypatch.setattr(tiled, "TILE", 16)
    monkeypatch.setattr(tiled, "CHUNK", 24)
    same(*both(pdf, "gaussian", 6))
    same(*both(rows(333, "poisson", 2), "poisson", 9))


def test_memory_is_one_tile():
    """No table of n^2 entries: the scores that a sweep shows at once are TILE rows of at most n."""
    n, seen = 3000, []
    b = segment.block_source(rows(n, "poisson"), "poisson", HYPER["poisson"])
    tiled.sweep(b, 3, visit=lambda cols, at, s, mean, left: seen.append(s.shape))
    assert max(a * b for a, b in seen) <= tiled.TILE * (n + 1) and sum(a for a, _ in seen) == n


def test_fit_chooses_tiles_by_length(spark):
    frames = [rows(n, "poisson").assign(seq_id=str(n), idx=range(1, n + 1), x=np.arange(n, dtype=float)) for n in (50, 90)]
    seq = spark.createDataFrame(pd.concat(frames))
    h = spark.createDataFrame([("50", 1.0, 0.3), ("90", 1.0, 0.3)], "seq_id string, alpha double, beta double")
    a = {r["seq_id"]: r.asDict() for r in segment.segment(seq, "poisson", 4, h).rows.collect()}
    b = {r["seq_id"]: r.asDict() for r in segment.segment(seq, "poisson", 4, h, dense_rows=60).rows.collect()}
    for q in a:
        same(a[q], b[q])


def test_too_long_is_refused(spark, monkeypatch):
    monkeypatch.setattr(segment, "LONGEST", 40)
    seq = spark.createDataFrame(rows(50, "poisson").assign(seq_id="a", idx=range(1, 51), x=0.0))
    with pytest.raises(Exception, match="sliding windows"):
        segment.segment(seq, "poisson", 2).rows.collect()


def test_families_of_the_registry_are_known():
    assert set(HYPER) <= set(families.FAMILIES)
