"""Distribution functions over batches against sums, and the discrete residuals made from them."""

import math

import numpy as np
import pytest

from stratafold.functions import incomplete
from stratafold.functions.special import beta_cdf
from stratafold.operators import predict


def log_beta(p, q):
    return math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q)


def test_incomplete_beta_equals_row_form():
    rng = np.random.default_rng(0)
    a, b = 10 ** rng.uniform(-2, 3, 800), 10 ** rng.uniform(-2, 3, 800)
    x = np.clip(rng.beta(a, b), 1e-12, 1 - 1e-12)
    want = np.array([beta_cdf(*z) for z in zip(x, a, b, strict=True)])
    assert np.abs(incomplete.incomplete_beta(x, a, b) - want).max() < 1e-10
    edge = incomplete.incomplete_beta([0.0, -1.0, 1.0, 2.0, np.nan, 0.5, 0.5], [1, 1, 1, 1, 1, 0, 2], [1, 1, 1, 1, 1, 1, np.nan])
    assert edge[:4].tolist() == [0, 0, 1, 1] and np.isnan(edge[4:]).all()
    assert incomplete.incomplete_beta([], [], []).shape == (0,)
    assert abs(incomplete.incomplete_beta(0.3, 1e6, 3e6)[0] - 1) < 1e-12 and abs(incomplete.incomplete_beta(0.25, 1e6, 3e6)[0] - 0.5) < 1e-3


def test_beta_less_equals_sums():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, (a, b), r = int(10 ** rng.uniform(0, 3)), 10 ** rng.uniform(-1.5, 3, 2), 10 ** rng.uniform(-1, 2)
        y = int(rng.integers(0, n))
        binomial = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + log_beta(a + k, b + n - k) - log_beta(a, b)) for k in range(y + 1))
        negbin = math.fsum(math.exp(math.lgamma(k + r) - math.lgamma(k + 1) - math.lgamma(r) + log_beta(a + r, b + k) - log_beta(a, b)) for k in range(y + 1))
        assert abs(incomplete.beta_less(n - y, y + 1, b, a)[0] - binomial) < 1e-9
        assert abs(incomplete.beta_less(r, y + 1, a, b)[0] - negbin) < 1e-9
    assert abs(incomplete.beta_less(3, 5, 3, 5)[0] - 0.5) < 1e-12 and np.isnan(incomplete.beta_less(0, 1, 1, 1)[0])


@pytest.mark.parametrize("name", ["poisson", "negbin", "binomial", "bernoulli"])
def test_bounds_equal_sums(spark, name):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        y = int(rng.integers(0, 2 if name == "bernoulli" else 40))
        rows.append(("s", float(k), k, float(y), float(rng.uniform(0.5, 3)), 40.0, float(rng.uniform(0.5, 4)), float(rng.uniform(0.2, 5)), float(rng.uniform(0.2, 5)), float(rng.uniform(0, 30)), float(rng.uniform(0, 30)), 50.0))
    df = spark.createDataFrame(rows, "seq_id string, x double, point int, y double, w double, n_trials double, r double, alpha double, beta double, s_s double, s_e double, s_m double")
    t = df.withColumn("log_density", predict.log_density(name))
    got = predict.pit(t, name, 5).collect()
    again = {r.point: r.pit for r in predict.pit(t.repartition(9), name, 5).collect()}
    for r in got:
        mass = spark_free_mass(name, r)
        assert abs(r.pit_low - math.fsum(mass[: int(r.y)])) < 1e-9 and abs(r.pit_high - math.fsum(mass)) < 1e-9
        assert r.pit_low <= r.pit <= r.pit_high and again[r.point] == r.pit  # the draw follows from the point
    assert len({r.pit for r in got}) > 20


def spark_free_mass(name, r):
    def one(k):
        a, b = r.alpha + r.s_s, r.beta + r.s_m - r.s_s
        if name == "poisson":
            b = r.beta + r.s_e
            return math.lgamma(k + a) - math.lgamma(a) - math.lgamma(k + 1) + a * math.log(b / (b + r.w)) + k * math.log(r.w / (b + r.w))
        if name == "negbin":
            a, b = r.alpha + r.s_m, r.beta + r.s_s
            return math.lgamma(k + r.r) - math.lgamma(k + 1) - math.lgamma(r.r) + log_beta(a + r.r, b + k) - log_beta(a, b)
        if name == "binomial":
            return math.lgamma(r.n_trials + 1) - math.lgamma(k + 1) - math.lgamma(r.n_trials - k + 1) + log_beta(a + k, b + r.n_trials - k) - log_beta(a, b)
        return math.log(a / (a + b) if k else b / (a + b))

    return [math.exp(one(k)) for k in range(int(r.y) + 1)]


def test_large_counts_cost_no_more(spark):
    """Bounds of counts in the millions, which a sum over counts could not give."""
    df = spark.createDataFrame([("s", 0.0, float(y), 1.0, 2e6, 5.0, 3.0, 4.0, 10.0, 1e-5, 20.0) for y in (3, 10**6, 1_900_000)], "seq_id string, x double, y double, w double, n_trials double, r double, alpha double, beta double, s_s double, s_e double, s_m double")
    for name in ("poisson", "negbin", "binomial"):
        rows = predict.pit_bounds(df.withColumn("log_density", predict.log_density(name)), name).orderBy("y").collect()
        low = [r.pit_low for r in rows]
        assert all(0 <= v <= 1 for v in low) and low == sorted(low) and all(r.pit_high >= r.pit_low for r in rows)


def test_segments_are_found_without_meeting_all(spark, capsys):
    seg = spark.createDataFrame([("a", 1, 0, 4, 1.0), ("a", 2, 4, 9, 2.0), ("b", 1, 0, 9, 5.0)], "seq_id string, q int, i int, j int, mean double")
    at = spark.createDataFrame([("a", 4, "x"), ("a", 5, "y"), ("a", 9, "z"), ("b", 1, "u"), ("b", 9, "v"), ("c", 1, "w")], "seq_id string, idx int, k string")
    assert {r.k: (r.q, r.i, r.j, r.mean) for r in predict.to_segment(at, seg).collect()} == {"x": (1, 0, 4, 1.0), "y": (2, 4, 9, 2.0), "z": (2, 4, 9, 2.0), "u": (1, 0, 9, 5.0), "v": (1, 0, 9, 5.0)}
