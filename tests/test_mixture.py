"""Latent groups against plain loops: M-step by enumeration, E-step by its formula, the whole fit step by step."""

import itertools

import numpy as np
import pytest

from stratafold.operators import dp, families, mixture, prior, segment
from stratafold.sources import sequences as src


@pytest.fixture(scope="module")
def seq(spark):
    rng = np.random.default_rng(8)
    rows = [(f"s{k:02d}", i + 1, float(i), float((3 if i >= (3 if k % 2 else 6) else 0) + 0.4 * rng.normal())) for k in range(14) for i in range(9)]
    return src.complete(spark.createDataFrame(rows, "seq_id string, idx int, x double, y double")).cache()


@pytest.fixture(scope="module")
def hyper(seq):
    return seq.select("seq_id").distinct().selectExpr("seq_id", "1.0D as nu", "4.0D as rho2", "0.16D as sigma2")


@pytest.fixture(scope="module")
def vec(seq, hyper):
    return mixture.vectors(seq, "gaussian", hyper).cache()


def best_by_enumeration(total, weight, n, k_max, count, factor=None):
    """(objective, k, cuts) over all partitions; the first with the largest value, fewer segments first."""
    i, j = mixture.pairs(n)
    s = {(int(a), int(b)): v for a, b, v in zip(i, j, total, strict=True)}
    g = {(int(a), int(b)): float(factor(np.array(a), np.array(b))) if factor else 0.0 for a, b in zip(i, j, strict=True)}
    log_p, out = prior.count_prior(count, k_max), []
    for k in range(1, k_max + 1):
        parts = [[0, *c, n] for c in itertools.combinations(range(1, n), k - 1)]
        log_c = np.logaddexp.reduce([sum(g[b] for b in itertools.pairwise(c)) for c in parts])
        for c in parts:
            v = sum(s[b] + weight * g[b] for b in itertools.pairwise(c)) + weight * (log_p[k - 1] - log_c)
            out.append((v, k, c))
    top = max(v for v, _, _ in out)
    return next(x for x in out if x[0] >= top - 1e-9)


def test_vectors_equal_block_table(seq, hyper, vec):
    a = {r.seq_id: r.scores for r in mixture.packed(families.blocks(seq, "gaussian", hyper)).collect()}
    for r in vec.collect():
        assert np.allclose(a[r.seq_id], r.scores, atol=1e-9)
    i, j = mixture.pairs(9)
    assert [(i[p], j[p]) for p in mixture.places([0, 2, 3, 9], 9)] == [(0, 2), (2, 3), (3, 9)]


@pytest.mark.parametrize("factor", [None, segment.length_factor(2), segment.length_factor(1, lambda x, ns: 0.7 * ns.ln(x))])
def test_m_step_equals_enumeration(spark, vec, factor):
    rng = np.random.default_rng(1)
    v = {r.seq_id: np.array(r.scores) for r in vec.collect()}
    r = {s: rng.dirichlet([1, 1]) for s in v}
    resp = spark.createDataFrame([(s, g, float(r[s][g])) for s in v for g in (0, 1)], "seq_id string, g int, r double")
    for parts in (1, 9):
        for row in mixture.templates(vec.repartition(parts), resp, 4, "uniform", factor).collect():
            weight = sum(r[s][row.g] for s in v)
            value, k, cuts = best_by_enumeration(sum(r[s][row.g] * v[s] for s in v), weight, 9, 4, "uniform", factor)
            assert (row.k, list(row.cuts)) == (k, cuts) and abs(row.objective - value) < 1e-8 and abs(row.pi - weight / len(v)) < 1e-12


def test_e_step_equals_formula(spark, vec):
    t = spark.createDataFrame([(0, 0.3, [0, 3, 9], -1.5), (1, 0.7, [0, 6, 7, 9], -2.5)], "g int, pi double, cuts array<int>, offset double")
    i, j = mixture.pairs(9)
    got = {(r.seq_id, r.g): (r.r, r.z) for r in mixture.responsibilities(vec, t).collect()}
    for row in vec.collect():
        s = {(int(a), int(b)): v for a, b, v in zip(i, j, row.scores, strict=True)}
        w = [sum(s[b] for b in itertools.pairwise(c)) + o + np.log(p) for p, c, o in ((0.3, [0, 3, 9], -1.5), (0.7, [0, 6, 7, 9], -2.5))]
        z = np.logaddexp(*w)
        for g in (0, 1):
            assert np.allclose(got[row.seq_id, g], (np.exp(w[g] - z), z))


def test_fit_is_the_steps_in_turn(spark, vec):
    """The fused passes give what the single steps give, for any number of tasks; the objective never falls."""
    fit = mixture.fit(vec, 2, 3, restarts=3, rounds=6, seed=2)
    history = [tuple(r) for r in fit["history"].orderBy("restart", "round").collect()]
    for number in range(3):
        run = mixture.Run(number, 2, 2 + number)
        first = mixture.seeds(vec, run)
        rows = vec.collect()
        r = mixture.nearest(np.array([x.scores for x in rows]), first)
        resp = spark.createDataFrame([(x.seq_id, g, float(r[k][g])) for k, x in enumerate(rows) for g in (0, 1)], "seq_id string, g int, r double")
        want = []
        for _ in [h for h in history if h[0] == number]:
            resp = spark.createDataFrame(mixture.responsibilities(vec, mixture.templates(vec, resp, 3)).collect())
            want.append(sum(x.z for x in resp.where("g = 0").collect()))
        assert np.allclose([h[2] for h in history if h[0] == number], want)
        assert not mixture.drops(want, 1e-6)
    again = mixture.fit(vec.repartition(7), 2, 3, restarts=3, rounds=6, seed=2)
    assert [(t.k, list(t.cuts)) for t in fit["templates"].collect()] == [(t.k, list(t.cuts)) for t in again["templates"].collect()] == [(2, [0, 3, 9]), (2, [0, 6, 9])]
    groups = {r.seq_id: r.g for r in fit["members"].where("r > 0.5").collect()}
    assert all(groups[s] == (0 if int(s[1:]) % 2 else 1) for s in groups)


def test_no_shuffle_by_block(vec, spark, capsys):
    resp = spark.createDataFrame([(r.seq_id, g, 0.5) for r in vec.select("seq_id").collect() for g in (0, 1)], "seq_id string, g int, r double")
    mixture.templates(vec, resp, 3).explain()
    plan = capsys.readouterr().out
    assert "Exchange" in plan and not any(f"hashpartitioning({k}#" in plan for k in ("i", "j")) and "CartesianProduct" not in plan


def test_choose_groups(vec):
    out = {r.groups: (r.held_out, r.sequences) for r in mixture.choose_groups(vec, [1, 2], 3, folds=2, restarts=2).collect()}
    assert out[2][0] > out[1][0] and out[1][1] == out[2][1] == 14


def test_group_marginals(spark, vec):
    t = spark.createDataFrame([(0, 2), (1, 3)], "g int, k int")
    v = [np.array(r.scores) for r in vec.orderBy("seq_id").collect()]
    resp = spark.createDataFrame([(r.seq_id, g, float(w)) for r in vec.select("seq_id").collect() for g, w in ((0, 0.25), (1, 0.75))], "seq_id string, g int, r double")
    p = {(r.g, r.pos): r.p for r in mixture.group_marginals(vec, resp, t).collect()}
    for g, k, w in ((0, 2, 0.25), (1, 3, 0.75)):
        s = np.full((10, 10), -np.inf)
        s[mixture.pairs(9)] = w * sum(v)
        want = dp.marginals(dp.forward(s, k), dp.backward(s, k), k)
        assert np.allclose([p[g, q] for q in range(1, 9)], want[1:9])


def test_unequal_lengths_are_refused(spark):
    bad = spark.createDataFrame([("a", [0.0]), ("b", [0.0] * 3)], "seq_id string, scores array<double>")
    with pytest.raises(ValueError, match="one length"):
        mixture.fit(bad, 1, 1)
