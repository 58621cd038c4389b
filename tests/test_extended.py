"""Baselines, quadrature, prediction and metrics against slower definitions."""

import itertools

import numpy as np
import pandas as pd
import pytest

from stratafold.operators import baselines, families, metrics, mixture, predict, prior, quadrature, segment
from stratafold.sources import sequences as src


def steps(rng, n, levels, noise=0.3):
    return np.repeat(levels, -(-n // len(levels)))[:n] + noise * rng.normal(size=n)


def total(cost, cut, penalty):
    return sum(cost(a, b) for a, b in zip(cut[:-1], cut[1:])) + penalty * (len(cut) - 2)


def test_pelt_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(600):
        n, size = int(rng.integers(4, 26)), int(rng.integers(1, 4))
        c, penalty = baselines.Cost(steps(rng, n, rng.normal(size=3), 0.5)), float(rng.choice([0.05, 0.3, 1.0, 3.0]))
        want = baselines.penalised(c, penalty, list(range(n + 1)), size)
        got = baselines.pelt(c, penalty, size)
        assert min(np.diff(got)) >= size and abs(total(c, got, penalty) - total(c, want, penalty)) < 1e-9


def test_multiscale_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(2, 9))
        y = steps(rng, n, [0.0, 4.0, 1.0], 0.6)
        c, s = baselines.Cost(y), np.concatenate([[0], np.cumsum(y)])

        def fits(i, j):
            low, high = -np.inf, np.inf
            for a, b in itertools.combinations(range(i, j + 1), 2):
                gap = (0.2 + np.sqrt(2 * np.log(np.e * n / (b - a)))) * 0.5 / np.sqrt(b - a)
                low, high = max(low, (s[b] - s[a]) / (b - a) - gap), min(high, (s[b] - s[a]) / (b - a) + gap)
            return low <= high

        best = next(k for k in range(n) if any(all(fits(a, b) for a, b in zip((0, *p), (*p, n))) for p in itertools.combinations(range(1, n), k)))
        got = baselines.multiscale(c, 0.2, 0.5)
        assert len(got) == best + 2 and all(fits(a, b) for a, b in zip(got[:-1], got[1:]))


def test_circular_and_sampled_find_clear_changes():
    y = steps(np.random.default_rng(2), 90, [0.0, 5.0, 0.0], 0.3)
    c = baselines.Cost(y)
    assert baselines.circular_binary_segmentation(c) == [0, 30, 60, 90]
    assert baselines.circular_binary_segmentation(baselines.Cost(np.random.default_rng(3).normal(size=60))) == [0, 60]
    got = baselines.sampled(c, 2 * 0.09 * np.log(90) * 2, 0.09)
    assert got == [0, 30, 60, 90]


def test_detect_and_requests(spark):
    y = steps(np.random.default_rng(2), 60, [0.0, 5.0], 0.2)
    seq = src.complete(spark.createDataFrame([("s", k + 1, float(k), float(v)) for k, v in enumerate(y)], "seq_id string, idx int, x double, y double"))
    for method, more in (("pelt", {"scale": 2.0}), ("smuce", {}), ("cbs", {}), ("mcmc", {"scale": 2.0}), ("binseg", {"changes": 1}), ("wbs", {"changes": 1})):
        assert list(baselines.detect(seq, method, **more).first()["boundaries"]) == [0, 30, 60], method


def test_sweep_equals_single_blocks():
    rng = np.random.default_rng(4)
    n = rng.integers(1, 9, 12).astype(float)
    y = np.array([float(rng.integers(0, k + 1)) for k in n])
    ev, mean = quadrature.sweep(y, n, -0.3, 0.9)
    for i, j in itertools.combinations(range(13), 2):
        a, b = quadrature.expectation(y[i:j], n[i:j], -0.3, 0.9, most=200)
        assert abs(ev[i, j] - a) < 1e-3 and abs(mean[i, j] - b) < 1e-4
        exact = quadrature.gh(np.array([y[i:j].sum()]), np.array([n[i:j].sum()]), -0.3, 0.9, 80)
        assert abs(ev[i, j] - exact[0][0]) < 0.02


def test_laplace_is_at_the_mode():
    s, n = np.array([0.0, 3.0, 50.0, 4000.0]), np.array([1.0, 3.0, 60.0, 4000.0])
    assert (quadrature.laplace(s, n, 0.2, 2.0)[2] < 1e-6).all()
    with pytest.raises(ValueError):
        quadrature.integrated(1.0, -1.0)
    assert quadrature.integrated(float("nan"))["status"] == "not_finite" and quadrature.integrated(2.0, 0.1)["value"] == 2.0


def frame(spark, y, **more):
    rows = pd.DataFrame({"seq_id": "s", "idx": np.arange(1, len(y) + 1, dtype=np.int32), "x": np.arange(float(len(y))), "y": np.asarray(y, float), **more})
    return src.complete(spark.createDataFrame(rows))


def test_beta_obs_prediction_is_a_distribution(spark):
    seq = frame(spark, [0.2, 0.25, 0.3, 0.7, 0.8, 0.75], phi=20.0)
    cut = spark.createDataFrame([("s", 1, 0, 3, 0.0), ("s", 2, 3, 6, 0.0)], "seq_id string, q int, i int, j int, mean double")
    h = spark.createDataFrame([("s", 2.0, 2.0)], "seq_id string, alpha double, beta double")
    w = predict.node_weights(seq, "beta_obs", cut, h, 16).groupBy("q").agg({"lw": "count"}).collect()
    assert {r[1] for r in w} == {16}
    grid = np.linspace(0, 1, 801)
    asked = spark.createDataFrame([("s", 1.0, float(v), 20.0, k) for k, v in enumerate(grid)], "seq_id string, x double, y double, phi double, point int")
    got = predict.score_points(seq, "beta_obs", cut, h, asked).orderBy("point").toPandas()
    d = np.exp(got["log_density"].to_numpy())
    assert d[0] == d[-1] == 0 and abs(np.trapezoid(d, grid) - 1) < 1e-4
    assert np.abs(np.concatenate([[0], np.cumsum((d[1:] + d[:-1]) / 2) * (grid[1] - grid[0])]) - got["pit"].to_numpy()).max() < 1e-3


def test_pit_router(spark):
    rng = np.random.default_rng(5)
    seq = frame(spark, rng.poisson(6, 200), n_trials=30.0)
    cut = spark.createDataFrame([("s", 1, 0, 200, 0.0)], "seq_id string, q int, i int, j int, mean double")
    for name, h in (("poisson", {"alpha": 2.0, "beta": 0.3}), ("binomial", {"alpha": 1.0, "beta": 1.0}), ("gaussian", {"nu": 5.0, "rho2": 9.0, "sigma2": 6.0})):
        hyper = spark.createDataFrame([("s", *h.values())], "seq_id string, " + ", ".join(f"{k} double" for k in h))
        u = predict.pit(predict.score_points(seq, name, cut, hyper, seq.select("seq_id", "x", "y", "w", "n_trials", "r")), name)
        assert metrics.ks_uniform(u).first()["ks"] < 0.12, name
    with pytest.raises(NotImplementedError):
        predict.pit(seq, "logistic_normal")


def test_bad_inputs_fail(spark):
    h = spark.createDataFrame([("s", 2.0, 1.0)], "seq_id string, alpha double, beta double")
    ok = frame(spark, [1, 0, 2], w=[1.0, 0.0, 1.0])
    assert segment.segment(ok, "poisson", 2, h).is_fitted() and segment.segment(ok, "poisson", 2, h).summary.count() == 1
    for y, w in (([1, 3, 2], [1.0, 0.0, 1.0]), ([1, 1, 2], [1.0, -1.0, 1.0])):
        bad = frame(spark, y, w=w)
        for run in (lambda: segment.segment(bad, "poisson", 2, h).summary.collect(), lambda: families.blocks(bad, "poisson", h).collect()):
            with pytest.raises(Exception, match="exposure|weights"):
                run()
    hidden = frame(spark, [1, 3, 2], w=[1.0, 0.0, 1.0], a=[1.0, 0.0, 1.0])
    assert segment.segment(hidden, "poisson", 2, h).summary.count() == 1


def test_matching_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(150):
        p, r = (sorted(rng.integers(0, 15, int(rng.integers(0, 5))).tolist()) for _ in range(2))
        best = (0, 0)
        for k in range(min(len(p), len(r)) + 1):
            for a in itertools.combinations(range(len(p)), k):
                for b in itertools.permutations(range(len(r)), k):
                    d = [abs(p[x] - r[y]) for x, y in zip(a, b)]
                    if all(v <= 3 for v in d):
                        best = max(best, (k, -sum(d)))
        got = metrics.match(p, r, 3)
        assert (len(got), -sum(abs(x - y) for x, y in got)) == best
        assert len(metrics.greedy_match(p, r, 3)) <= len(got)


def test_small_metrics(spark):
    for seed in range(20):
        b = metrics.random_boundaries(30, 4, 5, seed)
        assert b[0] == 0 and b[-1] == 30 and len(b) == 5 and min(np.diff(b)) >= 5
    with pytest.raises(ValueError):
        metrics.random_boundaries(5, 3, 2)
    rng = np.random.default_rng(7)
    t, f = rng.integers(0, 3, 60), rng.integers(0, 4, 60)
    want = max(np.mean([dict(zip(q, range(3))).get(b, -1) == a for a, b in zip(t, f)]) for q in itertools.permutations(range(4), 3))
    labels = spark.createDataFrame([(int(a), int(b)) for a, b in zip(t, f)], "truth int, found int")
    assert abs(metrics.permuted_accuracy(labels).first()["accuracy"] - want) < 1e-12
    curve = spark.createDataFrame([("s", 1, 1.0, 2.0), ("s", 2, 1.0, 1.0)], "seq_id string, idx int, mean double, signal double")
    assert metrics.signal_error(curve.drop("signal"), curve.drop("mean")).first()["mse"] == 0.5
    k = spark.createDataFrame([("s", 5, 3)], "seq_id string, k_map int, k int")
    assert metrics.count_error(k.drop("k"), k.drop("k_map")).first()["error"] == 2


def test_prior_lookups():
    assert abs(prior.count_at("uniform", 2, 4) + np.log(4)) < 1e-12 and prior.cohesion_at(4.0, 0.5, 2.0) == 0.5 * np.log(2)
    lam = 0.6
    assert abs(prior.hazard_at(2.0, 0.3) - (lam + np.log(1 - np.exp(-lam)))) < 1e-12
    for bad in (lambda: prior.count_at("uniform", 5, 4), lambda: prior.cohesion_at(0.0, 1.0), lambda: prior.hazard_at(1.0, 0.0)):
        with pytest.raises(ValueError):
            bad()


def test_mixture_score_and_group_marginals(spark):
    rng = np.random.default_rng(8)
    rows = [(f"s{k}", i + 1, float(i), float((3 if i >= (10 if k % 2 else 20) else 0) + 0.2 * rng.normal())) for k in range(6) for i in range(30)]
    seq = src.complete(spark.createDataFrame(rows, "seq_id string, idx int, x double, y double"))
    h = seq.select("seq_id").distinct().selectExpr("seq_id", "1.0D as nu", "4.0D as rho2", "0.05D as sigma2")
    b = families.blocks(seq, "gaussian", h).cache()
    fit = mixture.fit(b, 2, 3, 2, rounds=5)
    assert -0.01 < mixture.score(fit["members"]).first()["score"] <= 0
    p = mixture.group_marginals(b, fit["members"], fit["templates"]).toPandas()
    top = p.loc[p.groupby("g")["p"].idxmax()]
    assert sorted(top["pos"]) == [10, 20] and (top["p"] > 0.99).all()
