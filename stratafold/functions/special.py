"""Special functions twice: as Column expressions (`cols`) and over numpy arrays (`arrays`), under the same names.

Formulas of the families are written once against such a namespace and run in either engine.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 9
#: Coefficients of Stirling's series in 1/x, 1/x^3, 1/x^5, 1/x^7, 1/x^9.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def _lgamma(x, ns):
    """ln Gamma for x > 0: Stirling's series at x + SHIFT, less the logs of the factors passed on the way."""
    z = x + SHIFT
    series, p = STIRLING[0] / z, z
    for c in STIRLING[1:]:
        p = p * z * z
        series = series + c / p
    low = x
    for k in range(1, SHIFT):
        low = low * (x + k)
    return (z - 0.5) * ns.ln(z) - z + HALF_LOG_2PI + series - ns.ln(low)


def _namespace(ln, log1p, exp, where, greatest, tanh, sqrt, absolute) -> SimpleNamespace:
    ns = SimpleNamespace(ln=ln, log1p=log1p, exp=exp, where=where, greatest=greatest, tanh=tanh, sqrt=sqrt, abs=absolute)
    ns.lgamma = lambda x: _lgamma(x, ns)
    ns.lnbeta = lambda a, b: ns.lgamma(a) + ns.lgamma(b) - ns.lgamma(a + b)
    ns.lnchoose = lambda n, k: ns.lgamma(n + 1.0) - ns.lgamma(k + 1.0) - ns.lgamma(n - k + 1.0)
    ns.sigmoid = lambda t: 0.5 * (1.0 + ns.tanh(0.5 * t))
    ns.softplus = lambda t: ns.greatest(t, 0.0 * t) + ns.log1p(ns.exp(-ns.abs(t)))
    return ns


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


cols = _namespace(
    F.log, F.log1p, F.exp, lambda c, a, b: F.when(c, _c(a)).otherwise(_c(b)), lambda a, b: F.greatest(_c(a), _c(b)), F.tanh, F.sqrt, F.abs
)


def _quiet(f):
    def run(*a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return f(*a)

    return run


arrays = _namespace(_quiet(np.log), np.log1p, np.exp, np.where, np.maximum, np.tanh, np.sqrt, np.abs)


def lse(a: np.ndarray, axis: int | None = None) -> np.ndarray:
    """log sum exp; empty support (all -inf) gives -inf."""
    m = np.max(a, axis=axis, keepdims=True)
    safe = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        out = safe + np.log(np.sum(np.exp(a - safe), axis=axis, keepdims=True))
    return np.squeeze(out, axis=axis) if axis is not None else float(out.reshape(-1)[0])


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(np.asarray(z, float) / math.sqrt(2)))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz), mirrored where that converges faster."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for m in range(400):
        k = m // 2
        if m == 0:
            num = 1.0
        elif m % 2 == 0:
            num = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            num = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)
