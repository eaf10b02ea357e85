import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lambertlake.functions import dist, kernels as k


def test_textbook_quantiles():
    assert dist.f_ppf(0.95, 5, 5) == pytest.approx(5.0503, abs=1e-4)
    assert dist.f_ppf(0.975, 5, 5) == pytest.approx(7.1464, abs=1e-4)
    assert dist.f_ppf(0.95, 6, 4) == pytest.approx(6.1631, abs=1e-4)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.2281, abs=1e-4)
    assert dist.chi2_ppf(0.95, 1) == pytest.approx(3.8415, abs=1e-4)
    assert dist.chi2_ppf(0.99, 10) == pytest.approx(23.2093, abs=1e-4)


@settings(max_examples=60, deadline=None)
@given(st.floats(0.01, 0.99), st.floats(1, 60), st.floats(1, 60))
def test_quantiles_invert(p, a, b):
    assert dist.t_cdf(dist.t_ppf(p, a), a) == pytest.approx(p, abs=1e-9)
    assert dist.f_cdf(dist.f_ppf(p, a, b), a, b) == pytest.approx(p, abs=1e-9)
    assert dist.chi2_cdf(dist.chi2_ppf(p, a), a) == pytest.approx(p, abs=1e-9)


X = np.arange(200, 260.5, 0.5)


def test_savitzky_golay_keeps_polynomials():
    t = (X - 230) / 30
    y = np.stack([t**2, 1 + t - t**2])
    assert k.savitzky_golay(X, y, 11, 2) == pytest.approx(y)
    assert k.savitzky_golay(X, y, 11, 3, 1)[0] == pytest.approx(2 * t / 30)
    uneven = np.r_[X[:40], X[40:] + 0.2]
    # The even grid may end before the last point, which is then held.
    assert k.savitzky_golay(uneven, ((uneven - 230) / 30)[None], 7, 2)[0][:-1] == pytest.approx(((uneven - 230) / 30)[:-1])


def test_solvers_against_dense_algebra():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(3, 40))
    d = np.diff(np.eye(40), 2, axis=0)
    assert k.whittaker(y, 7.0) == pytest.approx(np.linalg.solve(np.eye(40) + 7 * d.T @ d, y.T).T)
    w, z = np.ones(40), None
    for _ in range(5):
        z = np.linalg.solve(np.diag(w) + 50 * d.T @ d, w * y[0])
        w = np.where(y[0] > z, 0.1, 0.9)
    assert k.als_baseline(y[:1], 50, 0.1, 5)[0] == pytest.approx(z)


def test_difference_derivative_trims():
    x, y = k.difference_derivative(X, (X**2)[None], 1, 4.0)
    assert (x[0], x[-1]) == (202.0, 258.0) and y[0] == pytest.approx(2 * x)
    with pytest.raises(k.SpectrumError):
        k.difference_derivative(X, (X**2)[None], 4, 40.0)


def test_moving_average_is_convolution():
    y = np.random.default_rng(1).normal(size=(1, 30))
    for window in (1, 4, 5, 30):
        want = np.convolve(y[0], np.ones(window), "same") / np.convolve(np.ones(30), np.ones(window), "same")
        assert k.moving_average(y, window)[0] == pytest.approx(want)


def test_finders():
    y = np.sin((X - 200) / 5)
    assert k.zero_crossings(X, y)[1] == pytest.approx(200 + 5 * math.pi, abs=1e-2)
    kinds = [e[2] for e in k.extrema(X, y)]
    assert kinds[:3] == ["max", "min", "max"]
    level = np.where((X > 210) & (X < 230), 1.0, X / 10)
    assert k.plateaus(X, level, 0.01, 5)[0][2] == pytest.approx(1.0, abs=1)
    assert k.longest_run(np.array([0, 1, 1, 0, 1, 1, 1], bool)) == (4, 7)
    assert k.peaks(np.array([0, 1, 1, 1, 0.0]), 0.1) == [2]
