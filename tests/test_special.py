"""Distribution functions against hand-worked values and exact sums."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plasmaflow.functions import special as sp


def test_goldens():
    assert sp.poisson_two_sided([5, 1, 5, 0], [1.0, 5.0, 5.0, 0]) == pytest.approx([0.007320, 0.080855, 1, 1], abs=1e-6)
    assert sp.binom_two_sided([10, 1, 10, 1, 9], [100, 100, 100, 10, 10], [0.01, 0.1, 0.1, 0, 1]) == pytest.approx([7.6316e-8, 6.336e-4, 1, 0, 0], rel=1e-3)
    assert sp.beta_binomial_sf([10, 1, 0], [100] * 3, [1.5] * 3, [400] * 3) == pytest.approx([2.3546e-7, 0.284324, 1], rel=1e-4)
    assert sp.fisher_two_sided([50, 10], [50, 10], [20, 3], [0, 2]) == pytest.approx([7.0483e-6, 1], rel=1e-3)
    assert float(sp.chi2_sf(17.034386, 6)) == pytest.approx(0.009158, abs=1e-5)
    assert sp.norm_isf([0.025, 0.5]) == pytest.approx([1.959964, 0], abs=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.integers(1, 60), st.integers(1, 99))
def test_binomial_tail_is_the_exact_sum(k, n, percent):
    p = Fraction(percent, 100)
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert float(sp.binom_sf(k, n, float(p))) == pytest.approx(float(exact), rel=1e-9, abs=1e-12)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 200), st.floats(0.01, 150))
def test_poisson_cdf_is_the_exact_sum(k, lam):
    exact = math.fsum(math.exp(-lam + i * math.log(lam) - math.lgamma(i + 1)) for i in range(k + 1))
    assert float(sp.poisson_cdf(k, lam)) == pytest.approx(exact, rel=1e-9, abs=1e-12)


@settings(max_examples=40, deadline=None)
@given(st.floats(0.5, 50), st.floats(0.5, 50), st.floats(0.001, 0.999))
def test_beta_quantile_inverts_the_tail(a, b, q):
    assert float(sp.beta_i(a, b, sp.beta_ppf(q, a, b))) == pytest.approx(q, abs=1e-9)


def test_tails_stay_probabilities():
    k, lam = np.meshgrid(np.arange(50), np.linspace(0.1, 40, 20))
    p = sp.poisson_two_sided(k.ravel(), lam.ravel())
    assert ((p >= 0) & (p <= 1)).all()
