"""Matrix kernels and optimisers against direct formulas and conditions."""

import numpy as np
import pytest

from ledgerline.operators import inference, kernels, optimize


@pytest.fixture
def x():
    return np.random.default_rng(42).normal(0, 0.02, (252, 12))


@pytest.fixture
def e():
    v = np.random.default_rng(1).normal(size=(12, 32))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_nearest_psd():
    assert np.linalg.eigvalsh(kernels.nearest_psd(np.array([[1.0, 2], [2, 1]]), 0.01))[0] >= 0.01


def test_shrinkage_by_definition(x):
    c = x - x.mean(axis=0)
    n, p = c.shape
    s = c.T @ c / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / n**2 / p, d2)
    assert abs(kernels.lw_shrinkage(x) - b2 / d2) < 1e-10
    assert abs(kernels.lw_shrinkage(x[:5]) - kernels.lw_shrinkage(np.asfortranarray(x[:5]))) < 1e-12


def test_estimators(x, e):
    sectors = ["36", "28", None] * 4
    for m in (kernels.shrunk(x, kernels.cosine(e))[0], kernels.shrunk(x, kernels.factor_correlation(e, 3)[0], 0.3)[0], kernels.multi_target(x, e, sectors)[0], kernels.multi_target(x, e, sectors, "frobenius")[0], kernels.cosine_covariance(e)):
        assert np.allclose(m, m.T) and np.linalg.eigvalsh(m)[0] > 0
    assert np.allclose(kernels.factor_correlation(e, 32)[0], kernels.cosine(e))
    assert kernels.cv_alpha(x, kernels.cosine(e)) in kernels.ALPHAS and kernels.cv_alpha(x[:12], kernels.cosine(e)) == 0.5
    c = kernels.sector_correlation(["a", "a", None, None])
    assert c[0, 1] == 0.5 and c[2, 3] == 0.2 and c[3, 3] == 1


def test_target_weights_have_the_least_realised_variance(x, e):
    """Every share of the grid, one by one, with targets at the scale of the first days."""
    targets = [kernels.cosine(e), kernels.sector_correlation(["36", "28", None] * 4), np.eye(12)]
    k = int(0.7 * len(x))
    first = np.cov(x[:k], rowvar=False)
    scale = np.sqrt(np.diag(first))[:, None] * np.sqrt(np.diag(first))[None, :]
    loss = {}
    for a in kernels.SHARES:
        for b in kernels.SHARES:
            for c in kernels.SHARES:
                if a + b + c <= 1:
                    m = kernels.nearest_psd((1 - a - b - c) * first + a * targets[0] * scale + b * targets[1] * scale + c * targets[2] * scale)
                    w = np.maximum(np.linalg.solve(m, np.ones(12)) / np.linalg.solve(m, np.ones(12)).sum(), 0)
                    loss[a, b, c] = np.var(x[k:] @ (w / w.sum()))
    got = tuple(kernels.cv_weights(x, targets))
    assert abs(loss[got] - min(loss.values())) < 1e-15
    assert (kernels.cv_weights(x[:15], targets) == 0.25).all() and kernels.lw_shrinkage(np.zeros((5, 3))) == 0


def test_optimiser(x):
    s = np.cov(x, rowvar=False)
    w, _ = optimize.optimise(0.04 * np.eye(3), cap=1.0)
    assert np.allclose(w, 1 / 3, atol=1e-6)
    w, _ = optimize.optimise(s, cap=0.2)
    g = s @ w
    free = (w > 1e-6) & (w < 0.2 - 1e-6)
    assert abs(w.sum() - 1) < 1e-9 and w.max() <= 0.2 + 1e-6 and np.ptp(g[free]) < 1e-8
    w, _ = optimize.optimise(np.array([[0.04, 0.01], [0.01, 0.09]]), cap=0.05)  # infeasible cap
    assert np.allclose(w, 0.5)
    w, _ = optimize.optimise(s, groups=[(np.arange(6), 0.3)], cap=0.2)
    assert w[:6].sum() <= 0.3 + 1e-3
    for objective in ("max_sharpe", "risk_parity", "mean_variance"):
        w, _ = optimize.optimise(s, np.linspace(0, 0.001, 12), objective, cap=0.5)
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0
    w, _ = optimize.optimise(np.diag([0.01, 0.04]), objective="risk_parity", cap=1.0)
    assert np.allclose(w, [2 / 3, 1 / 3], atol=1e-3)
    w, n = optimize.capped_equal_weights(["a"] * 8 + ["b"] * 2, {"a": 0.5})
    assert abs(w[:8].sum() - 0.5) < 1e-9 and n == 1


def test_resampling():
    assert inference.permutation_p(np.tile([1.0, 2, 3], 40), np.tile([4.0, 5, 6], 40), block=3, draws=200)[0] == -3
    d, p = inference.permutation_p(np.ones(500), np.ones(500), draws=100)
    assert d == 0 and p == 1
    rng = np.random.RandomState(42)
    v = rng.normal(size=200)
    m, lo, hi = inference.bootstrap_ci(v, block=20, draws=500)
    assert lo < m < hi
    rng = np.random.RandomState(7)  # one draw at a time
    means = [np.concatenate([v[s : s + 20] for s in rng.randint(0, 181, size=10)]).mean() for _ in range(50)]
    assert np.allclose(inference.bootstrap_ci(v, 20, 50, seed=7)[1:], np.percentile(means, [2.5, 97.5]))
    assert inference.lo_eta(v[:50]) == 1.0
