"""The level-wise solver against the dense one, and on a factor with thousands of levels."""

import numpy as np
import pytest

from ratewise.operators.glm import LevelDesign, kept_columns, level_fit, newton_fit


def dense(design):
    x = np.zeros((design.cells, design.columns))
    x[:, 0] = 1
    for c, k, s in zip(design.codes, design.sizes, design.starts):
        for j in range(1, k):
            x[c == j, s + j - 1] = 1
    return x


def responses(family, design, n, r):
    beta = r.normal(0, 0.4, design.columns)
    eta = design.eta(beta)
    if family == "poisson":
        return r.poisson(n * np.exp(eta)).astype(float)
    if family == "binomial":
        return r.binomial(n, 1 / (1 + np.exp(-eta))).astype(float)
    return r.gamma(2 * n, np.exp(eta + 5) / 2)


def random_design(r, sizes, cells):
    codes = [np.concatenate([np.arange(k), r.integers(0, k, cells - k)]) for k in sizes]
    for c in codes:
        r.shuffle(c)
    return LevelDesign(codes, sizes, cells)


@pytest.mark.parametrize("family", ["poisson", "binomial", "gamma"])
@pytest.mark.parametrize("sizes", [[3], [2, 4, 3], [3, 30, 2], [40, 5, 5], [], [1, 4, 1]])
def test_equals_the_dense_fit(family, sizes):
    r = np.random.default_rng(len(sizes) * 7 + sum(sizes))
    d = random_design(r, sizes, 300)
    n = r.integers(20, 60, 300).astype(float)
    sy = responses(family, d, n.astype(int), r)
    x = dense(d)
    keep = kept_columns(x)
    assert np.flatnonzero(d.kept()).tolist() == keep
    want, _, ok = newton_fit(family, x[:, keep], n, sy)
    got, kept, _, converged = level_fit(family, d, n, sy)
    assert ok and converged and not got[~kept].any()
    np.testing.assert_allclose(got[kept], want, rtol=1e-9, atol=1e-9)


def test_same_columns_are_aliased():
    """A factor that repeats another, one that is their combination, and a level without cells."""
    r = np.random.default_rng(3)
    a = r.integers(0, 4, 200)
    b = r.integers(0, 3, 200)
    for codes, sizes in (([a, a, b], [4, 4, 3]), ([a, b, a * 3 + b], [4, 3, 12]), ([a * 3 + b, a, b], [12, 4, 3]), ([b, np.where(a == 2, 0, a)], [3, 4])):
        d = LevelDesign(codes, sizes, 200)
        assert np.flatnonzero(d.kept()).tolist() == kept_columns(dense(d))


@pytest.mark.parametrize("family", ["poisson", "gamma"])
def test_five_thousand_levels_fit_in_little_memory(family):
    """The peak of the numpy arrays stays far under a gigabyte; the dense matrix alone would have 1.6."""
    import tracemalloc

    r = np.random.default_rng(5)
    d = random_design(r, [5000, 4, 3, 5], 40_000)
    n = r.integers(1, 30, 40_000).astype(float)
    sy = responses(family, d, n.astype(int), r)
    tracemalloc.start()
    beta, kept, _, converged = level_fit(family, d, n, sy)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert converged and peak < 100e6
    mu = np.exp(np.clip(d.eta(beta), -60, 60))
    for c, k in zip(d.codes, d.sizes):
        if family == "poisson":
            np.testing.assert_allclose(np.bincount(c, n * mu, k), np.bincount(c, sy, k), atol=1e-4)
        else:
            np.testing.assert_allclose(np.bincount(c, sy / mu, k), np.bincount(c, n, k), rtol=1e-6)
