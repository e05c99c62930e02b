"""Properties over random inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from phenoloom.functions import distributions as D
from phenoloom.operators import ml, scan


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=20), st.integers(3, 600))
def test_tail_is_a_probability_and_falls(t, df):
    t = np.sort(np.abs(np.array(t)))
    p = D.t_two_sided_array(t, df)
    assert ((p >= 0) & (p <= 1)).all() and (np.diff(p) <= 1e-9).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 300), st.integers(2, 10), st.integers(0, 10**6))
def test_folds_are_even(n, k, seed):
    sizes = np.bincount(ml.kfold(n, k, seed), minlength=k)
    assert sizes.sum() == n and sizes.max() - sizes.min() <= 1


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.1, 100), st.floats(-100, 100))
def test_scan_does_not_care_for_scale_or_shift(seed, scale, shift):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, (4, 40)).astype(float)
    g[:, 0], g[:, 1] = 0, 2
    y = rng.normal(size=40)
    a = scan.scan_block(g, scan.covariate_basis(y))[1]
    b = scan.scan_block(g, scan.covariate_basis(scale * y + shift))[1]
    assert np.allclose(a, b, rtol=1e-5, atol=1e-7)
