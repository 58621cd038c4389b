"""Best relabellings against all of them."""

import itertools

import numpy as np

from stratafold.operators import metrics


def test_assignment_equals_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(1, 7, 2).tolist()
        g = rng.integers(0, 9, (a, b)).astype(float)
        small = g if a <= b else g.T
        want = max(sum(small[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(max(a, b)), min(a, b)))
        assert metrics.assignment(g) == want


def test_many_groups():
    rng = np.random.default_rng(1)
    p = rng.permutation(150)
    g = rng.random((150, 150))
    g[np.arange(150), p] += 2
    assert abs(metrics.assignment(g) - g[np.arange(150), p].sum()) < 1e-9


def test_accuracy_by_key(spark):
    rows = [("x", k % 30, (k + 7) % 30) for k in range(300)] + [("y", 1, 5), ("y", 1, 5), ("y", 2, 5), ("y", None, 6), ("y", 3, None)]
    df = spark.createDataFrame(rows, "k string, truth int, found int")
    got = {r.k: r.accuracy for r in metrics.permuted_accuracy(df, ["k"]).collect()}
    assert got["x"] == 1.0 and abs(got["y"] - 4 / 5) < 1e-12
    assert metrics.permuted_accuracy(df.where("k = 'x'")).first()["accuracy"] == 1.0
