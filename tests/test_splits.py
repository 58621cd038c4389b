"""Splits as DataFrame operations against plain loops."""

import numpy as np
import pytest

from stratafold.operators import baselines, splits
from stratafold.sources import sequences as src


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(2)
    out = {"short": np.array([1.0, 2.0, 9.0]), "two": np.array([1.0, 5.0]), "flat": np.repeat(2.0, 20) + 1e-3 * rng.normal(size=20)}
    for s, n in (("a", 90), ("b", 61)):
        out[s] = np.repeat(rng.normal(0, 4, 6), -(-n // 6))[:n] + rng.normal(size=n)
    return out


@pytest.fixture(scope="module")
def seq(spark, series):
    return src.complete(spark.createDataFrame([(s, i + 1, float(i), float(y)) for s, v in series.items() for i, y in enumerate(v)], "seq_id string, idx int, x double, y double")).cache()


def rows(df):
    return {r.seq_id: r for r in df.collect()}


@pytest.mark.parametrize("chunk", [7, 4096])
def test_prefix_sums(series, seq, chunk):
    got = {}
    for r in splits.prefix_sums(seq, chunk).collect():
        got.setdefault(r.seq_id, {})[r.pos] = (r.s, r.q)
    for s, y in series.items():
        want = np.concatenate([[[0, 0]], np.cumsum(np.stack([y, y * y], 1), axis=0)])
        assert sorted(got[s]) == list(range(len(y) + 1)) and np.allclose([got[s][k] for k in range(len(y) + 1)], want)


@pytest.mark.parametrize("how", [{"changes": 4}, {"penalty": 9.0}, {"changes": 0}, {"penalty": 1e9}])
def test_binary_segmentation_equals_loops(series, seq, how):
    got = rows(splits.binary_segmentation(seq, **how, rows=16))
    for s, y in series.items():
        c = baselines.Cost(y)
        want = baselines.binary_segmentation(c, **how)
        assert got[s].boundaries == want and abs(got[s].cost - sum(c(a, b) for a, b in zip(want[:-1], want[1:]))) < 1e-8


@pytest.mark.parametrize("how", [{"changes": 3}, {"penalty": 9.0}])
def test_wild_splits_equal_loops(series, seq, how):
    windows = {}
    for r in splits.wild_windows(seq, 40, 5).collect():
        assert 0 <= r.lo <= r.hi <= len(series[r.seq_id])
        windows.setdefault(r.seq_id, set()).add((r.lo, r.hi))
    assert windows["a"] == {(r.lo, r.hi) for r in splits.wild_windows(seq.repartition(5), 40, 5).where("seq_id = 'a'").collect()} and len(windows["a"]) > 30
    got = rows(splits.wild_binary_segmentation(seq, windows=40, seed=5, rows=16, **how))
    for s, y in series.items():
        c = baselines.Cost(y)
        found = set()
        for lo, hi in windows[s]:
            t = np.arange(lo + 2, hi - 1)
            if len(t):
                g = c(lo, hi) - c(lo, t) - c(t, hi)
                found.add(int(t[np.flatnonzero(g == g.max())[-1]]))
        cand = sorted(found)
        if "changes" in how:
            k = min(how["changes"], len(cand))
            while True:
                try:
                    want = baselines.optimal(c, k, 2, cand)
                    break
                except ValueError:
                    k -= 1
        else:
            want = baselines.penalised(c, how["penalty"], cand)
        value = lambda b: sum(c(x, z) for x, z in zip(b[:-1], b[1:])) + how.get("penalty", 0.0) * len(b)  # noqa: B023, E731
        assert set(got[s].boundaries) <= {0, len(y), *cand} and (abs(value(got[s].boundaries) - value(want)) < 1e-8 or len(got[s].boundaries) != len(want))


def test_optimal_partition(series, seq):
    long = seq.where("seq_id in ('a', 'b', 'flat')")
    got = rows(splits.optimal_partition(long, 3))
    for s in ("a", "b", "flat"):
        c = baselines.Cost(series[s])
        want = baselines.optimal(c, 3)
        assert abs(got[s].cost - sum(c(x, z) for x, z in zip(want[:-1], want[1:]))) < 1e-8 and len(got[s].boundaries) == 5 and min(np.diff(got[s].boundaries)) >= 2
    with pytest.raises(Exception, match="no partition"):
        splits.optimal_partition(seq, 3).collect()


def test_no_cross_join(seq, capsys):
    p = splits.prefix_sums(seq)
    splits.best_splits(p, splits.wild_windows(seq, 10)).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "partial_max" in plan
