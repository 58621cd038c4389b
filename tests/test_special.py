import math

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from stratafold.functions.special import arrays, beta_cdf, lse, normal_cdf


@given(st.floats(1e-3, 1e6))
def test_lgamma(x):
    assert abs(float(arrays.lgamma(np.float64(x))) - math.lgamma(x)) <= 5e-13 * (1 + abs(math.lgamma(x)))


def test_lse_of_nothing():
    assert lse(np.array([-np.inf, -np.inf])) == -np.inf
    assert abs(lse(np.log([1.0, 2.0, 3.0])) - math.log(6)) < 1e-12


def test_cdfs():
    assert abs(normal_cdf(np.array([1.96]))[0] - 0.9750021) < 1e-6
    assert abs(beta_cdf(0.5, 2, 2) - 0.5) < 1e-12
    assert abs(beta_cdf(0.3, 2, 5) - sum(math.comb(6, k) * 0.3**k * 0.7 ** (6 - k) for k in range(2, 7))) < 1e-10
