"""Distribution functions over whole arrays: the regularised incomplete beta function, and comparisons of two beta variables.

All rows of a batch advance together; a row that has converged waits for the others. The work per row does not depend on
counts: the sums over 0..y of discrete predictive masses are probabilities that one beta variable is below another.
"""

from __future__ import annotations

import numpy as np

from .special import _lgamma, arrays

#: Steps of the continued fraction; it needs some multiple of the square root of the larger parameter.
MOST = 20_000
TINY = 1e-300
#: Nodes a panel, halvings of the panels towards the centre, log weight that counts as nothing.
NODES, HALVINGS, NOTHING = 12, 12, 45.0


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return _lgamma(a, arrays) + _lgamma(b, arrays) - _lgamma(a + b, arrays)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function by the modified Lentz method, from x below its mean."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < TINY, TINY, d)
    f = d.copy()
    at = np.arange(len(x))  # the rows still moving
    out = np.empty_like(x)
    for m in range(1, MOST):
        n = a + 2 * m
        for num in (m * (b - m) * x / ((n - 1) * n), -(a + m) * (a + b + m) * x / (n * (n + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            f = f * (c * d)
        moving = np.abs(c * d - 1.0) > 1e-15
        if not moving.all():
            out[at[~moving]] = f[~moving]
            at, a, b, x, c, d, f = (v[moving] for v in (at, a, b, x, c, d, f))
            if not len(at):
                return out
    out[at] = f
    return out


def incomplete_beta(x, a, b) -> np.ndarray:
    """I_x(a, b) of each row: 0 up to x = 0, 1 from x = 1 on; NaN where an argument is NaN or a parameter not positive."""
    x, a, b = (np.array(v, float).reshape(-1) for v in np.broadcast_arrays(x, a, b))
    out = np.where(x >= 1, 1.0, 0.0)
    bad = ~((a > 0) & (b > 0)) | np.isnan(x)
    inner = np.flatnonzero((x > 0) & (x < 1) & ~bad)
    if len(inner):
        x_, a_, b_ = x[inner], a[inner], b[inner]
        flip = x_ > (a_ + 1) / (a_ + b_ + 2)
        p, q, u = np.where(flip, b_, a_), np.where(flip, a_, b_), np.where(flip, 1 - x_, x_)
        front = np.exp(p * np.log(u) + q * np.log1p(-u) - log_beta(p, q)) / p
        v = front * _fraction(p, q, u)
        out[inner] = np.clip(np.where(flip, 1 - v, v), 0.0, 1.0)
    out[bad] = np.nan
    return out


_x, _w = np.polynomial.legendre.leggauss(NODES)


def beta_less(a1, b1, a2, b2) -> np.ndarray:
    """P(U <= V) for independent U ~ Beta(a1, b1) and V ~ Beta(a2, b2), row by row.

    The density of V on the log-odds scale times the distribution function of U, over panels that shrink towards the
    centre of V and, as finely as U's own spread asks, towards the centre of U."""
    a1, b1, a2, b2 = (np.array(v, float).reshape(-1) for v in np.broadcast_arrays(a1, b1, a2, b2))
    out = np.full(len(a1), np.nan)
    ok = np.flatnonzero((a1 > 0) & (b1 > 0) & (a2 > 0) & (b2 > 0))
    for lo in range(0, len(ok), 256):
        r = ok[lo : lo + 256]
        p, q, a, b = a1[r], b1[r], a2[r], b2[r]
        centre, spread = np.log(a / b), np.sqrt(1 / a + 1 / b)
        left, right = np.maximum(NOTHING / a, 12 * spread), np.maximum(NOTHING / b, 12 * spread)
        steps = 2.0 ** -np.arange(HALVINGS)
        cuts = [centre[:, None] - left[:, None] * steps, centre[:, None], centre[:, None] + right[:, None] * steps]
        other, width = np.log(p / q), np.sqrt(1 / p + 1 / q)
        cuts.append(other[:, None] + width[:, None] * np.array([-12, -8, -5, -3, -1.5, -0.6, 0, 0.6, 1.5, 3, 5, 8, 12]))
        ends = np.sort(np.clip(np.concatenate(cuts, axis=1), (centre - left)[:, None], (centre + right)[:, None]), axis=1)
        half = np.diff(ends, axis=1)[:, :, None] / 2
        t = ends[:, :-1, None] + half * (1 + _x)
        wt = half * _w
        # log density of V's log odds, and the odds on both sides without cancellation
        soft = np.logaddexp(0.0, -np.abs(t))
        log_v, log_1v = np.where(t > 0, 0.0, t) - soft, np.where(t > 0, -t, 0.0) - soft
        f = np.exp(a[:, None, None] * log_v + b[:, None, None] * log_1v - log_beta(a, b)[:, None, None])
        some = (wt * f) > 1e-18
        k = np.nonzero(some)[0]
        cdf = np.zeros(t.shape)
        cdf[some] = incomplete_beta(np.exp(log_v[some]), p[k], q[k])
        out[r] = np.clip((wt * f * cdf).sum(axis=(1, 2)) / (wt * f).sum(axis=(1, 2)), 0.0, 1.0)
    return out
