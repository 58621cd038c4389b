"""One posterior over the windows' candidates against the dense fit."""

import numpy as np
import pytest

from stratafold.operators import families, segment, sliding
from stratafold.sources import sequences as src


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    levels = [0.0, 4.0, -3.0, 1.0]
    rows = [(s, i + 1, float(i), float(levels[i * 4 // n] + 0.6 * rng.normal())) for s, n in (("a", 120), ("b", 57), ("c", 3)) for i in range(n)]
    seq = src.complete(spark.createDataFrame(rows, "seq_id string, idx int, x double, y double")).cache()
    return seq, families.hyper(seq, "gaussian")


@pytest.mark.parametrize("size,overlap", [(40, 10), (25, 1), (500, 5)])
def test_all_positions_give_the_dense_fit(data, size, overlap):
    seq, h = data
    dense = {r.seq_id: r for r in segment.segment(seq, "gaussian", 6, h).rows.collect()}
    for r in sliding.stitched(seq, "gaussian", 6, size, overlap, h, least=0.0).collect():
        d = dense[r.seq_id]
        assert r.candidates == list(range(d.n + 1)) and r.k_map == d.k_map and r.boundaries == d.boundaries
        assert abs(r.log_evidence - d.log_evidence) < 1e-8 and np.allclose(r.log_post, d.log_post, atol=1e-8)
        assert np.allclose(r.marginal, d.marginal_mixed, atol=1e-9) and np.allclose(r.curve, d.curve_mixed, atol=1e-8) and np.allclose(r.means, d.means)


def test_few_candidates_keep_nearly_all(data):
    seq, h = data
    dense = {r.seq_id: r for r in segment.segment(seq, "gaussian", 6, h).rows.collect()}
    fit = sliding.stitched(seq, "gaussian", 6, 50, 20, h, least=0.01)
    for r in fit.collect():
        d = dense[r.seq_id]
        assert len(r.candidates) < 0.8 * d.n or d.n < 10
        assert d.log_evidence - 0.5 < r.log_evidence <= d.log_evidence + 1e-9 and r.boundaries == d.boundaries
        p = dict(zip(r.candidates, r.marginal, strict=True))
        assert max(abs(p.get(q, 0.0) - d.marginal_mixed[q]) for q in range(1, d.n)) < 0.1
    seg = sliding.stitched_segment(fit).where("seq_id = 'a'").orderBy("q").collect()
    assert [(s.i, s.j) for s in seg] == list(zip(dense["a"].boundaries[:-1], dense["a"].boundaries[1:]))
    cells = sliding.stitched_curve(fit).where("seq_id = 'a'").orderBy("i").collect()
    assert cells[0].i == 0 and cells[-1].j == 120 and all(x.j == y.i for x, y in zip(cells[:-1], cells[1:]))
    assert sliding.stitched_marginal(fit).where("pos = 0 or p < 0 or p > 1.000001").count() == 0


def test_windows_without_overlap_see_their_edges(data):
    seq, h = data
    fit = {r.seq_id: r for r in sliding.stitched(seq, "gaussian", 6, 30, 0, h).collect()}
    assert {0, 30, 60, 90, 120} <= set(fit["a"].candidates) and fit["a"].boundaries == [0, 30, 60, 90, 120]
