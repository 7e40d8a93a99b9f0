"""Portfolio programs of one cross-section, in numpy: projected gradients on the capped simplex, ADMM for sector caps."""

from __future__ import annotations

import numpy as np

OBJECTIVES = ("min_variance", "mean_variance", "max_sharpe", "risk_parity")


def project(v: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Nearest point with sum 1 and entries within [lo, hi]; if hi is too low for that, all at the level that sums to 1."""
    n = len(v)
    if n * hi <= 1.0 or n * lo >= 1.0:
        return np.full(n, 1.0 / n)
    a, b = v.min() - hi, v.max() - lo
    for _ in range(100):
        m = (a + b) / 2
        if np.clip(v - m, lo, hi).sum() > 1:
            a = m
        else:
            b = m
    return np.clip(v - (a + b) / 2, lo, hi)


def quadratic(q: np.ndarray, c: np.ndarray, lo: float, hi: float, iterations: int = 5000, tolerance: float = 1e-12) -> np.ndarray:
    """Least w'qw / 2 - c'w over the capped simplex, by accelerated projected gradients with restarts."""
    n = len(q)
    step = 1.0 / max(np.linalg.eigvalsh(q)[-1], 1e-18)
    w = y = np.full(n, 1.0 / n)
    t = 1.0
    for _ in range(iterations):
        new = project(y - step * (q @ y - c), lo, hi)
        if (new - w) @ (y - new) > 0:
            t, y = 1.0, w
            new = project(w - step * (q @ w - c), lo, hi)
        up = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / up * (new - w)
        if np.abs(new - w).max() < tolerance:
            return new
        w, t = new, up
    return w


def quadratic_with_groups(q: np.ndarray, c: np.ndarray, lo: float, hi: float, groups: list[tuple[np.ndarray, float]], iterations: int = 4000) -> np.ndarray | None:
    """The same with a cap on the sum of each group, by operator splitting; None if it finds no feasible point."""
    n = len(q)
    a = np.vstack([np.ones(n), np.eye(n), *(np.isin(np.arange(n), k).astype(float) for k, _ in groups)])
    low = np.r_[1.0, np.full(n, lo), np.full(len(groups), -np.inf)]
    high = np.r_[1.0, np.full(n, hi), [m for _, m in groups]]
    scale = np.trace(q) / n or 1.0
    q, c = q / scale, c / scale
    rho, sigma = 1.0, 1e-6
    weight = np.where(low == high, 1e3 * rho, rho)
    inverse = np.linalg.inv(q + sigma * np.eye(n) + (a.T * weight) @ a)
    w, z, y = np.full(n, 1.0 / n), np.clip(a @ np.full(n, 1.0 / n), low, high), np.zeros(len(a))
    for _ in range(iterations):
        w = inverse @ (sigma * w + c + a.T @ (weight * z - y))
        aw = a @ w
        z = np.clip(aw + y / weight, low, high)
        y = y + weight * (aw - z)
        if np.abs(aw - z).max() < 1e-9 and np.abs(q @ w - c + a.T @ y).max() < 1e-8:
            break
    return w if np.abs(a @ w - np.clip(a @ w, low, high)).max() < 1e-4 else None


def _descend(value, gradient, n: int, lo: float, hi: float, iterations: int = 2000) -> np.ndarray:
    """Projected gradient with backtracking, from equal weights."""
    w, step = np.full(n, 1.0 / n), 1.0
    f = value(w)
    for _ in range(iterations):
        g = gradient(w)
        while step > 1e-16:
            new = project(w - step * g, lo, hi)
            fn = value(new)
            if fn <= f - 1e-4 * ((w - new) @ (w - new)) / step:
                break
            step /= 2
        else:
            break
        done = f - fn < 1e-14 * max(1.0, abs(f))
        w, f, step = new, fn, step * 2
        if done:
            break
    return w


def clean(w: np.ndarray, cap: float) -> np.ndarray:
    """Dust to zero, sum to one, cap, sum to one again (which may exceed the cap once more)."""
    w = np.where(np.abs(w) < 1e-6, 0.0, w)
    w = np.minimum(w / w.sum(), cap)
    return w / w.sum()


def optimise(sigma: np.ndarray, mu: np.ndarray | None = None, objective: str = "min_variance", cap: float = 0.05, long_only: bool = True, risk_aversion: float = 1.0, groups: list[tuple[np.ndarray, float]] | None = None, vol_target: float | None = None) -> tuple[np.ndarray, dict]:
    """Weights and facts about them. Group caps count for the two quadratic objectives; a program that they make infeasible is solved without."""
    n = len(sigma)
    mu = np.zeros(n) if mu is None else mu
    lo = 0.0 if long_only else -cap
    facts: dict = {"objective": objective}
    if objective in ("min_variance", "mean_variance"):
        q, c = (2 * sigma, np.zeros(n)) if objective == "min_variance" else (risk_aversion * sigma, mu)
        w = quadratic_with_groups(q, c, lo, cap, groups) if groups and n * cap > 1 else None
        facts["groups_kept"] = w is not None
        if w is None:
            w = quadratic(q, c, lo, cap)
    elif objective == "max_sharpe":

        def value(w):  # noqa: ANN001, ANN202
            return -(w @ mu) / np.sqrt(max(w @ sigma @ w, 1e-12))

        def gradient(w):  # noqa: ANN001, ANN202
            v = max(w @ sigma @ w, 1e-12)
            return -mu / np.sqrt(v) + (w @ mu) * (sigma @ w) / v**1.5

        w = _descend(value, gradient, n, lo, cap)
    elif objective == "risk_parity":

        def value(w):  # noqa: ANN001, ANN202
            v = w @ sigma @ w
            return 0.0 if v < 1e-12 else float(((w * (sigma @ w) / v - 1 / n) ** 2).sum())

        def gradient(w):  # noqa: ANN001, ANN202
            s = sigma @ w
            v = w @ s
            if v < 1e-12:
                return np.zeros(n)
            d = w * s / v - 1 / n
            return 2 * (d * s / v + sigma @ (d * w) / v - (d @ (w * s)) * 2 * s / v**2)

        w = _descend(value, gradient, n, lo, cap)
    else:
        raise ValueError(f"unknown objective: {objective}")
    w = clean(w, cap)
    facts["variance"] = float(w @ sigma @ w)
    if vol_target is not None and (vol := np.sqrt(facts["variance"] * 252)) > 1e-10:
        w = w * (vol_target / vol)
        facts |= {"vol_scale": float(vol_target / vol), "predicted_vol": float(vol)}
    return w, facts


def capped_equal_weights(sectors: list[str | None], limits: dict[str, float], rounds: int = 10) -> tuple[np.ndarray, int]:
    """Equal weights with sectors cut to their limits and the excess dealt evenly to the others; how many are at their limit."""
    n = len(sectors)
    code = np.array([s or "_unknown" for s in sectors])
    names, of = np.unique(code, return_inverse=True)
    limit = np.array([limits.get(s, 1.0) for s in names])
    w = np.full(n, 1.0 / n)
    for _ in range(rounds):
        total = np.bincount(of, w, len(names))
        over = total > limit + 1e-10
        excess = (total - limit)[over].sum()
        w = np.where(over[of], w * (limit / np.where(total > 0, total, 1))[of], w)
        free = ~over[of]
        if excess < 1e-10 or not free.any():
            break
        w[free] += excess / free.sum()
    w = w / w.sum()
    return w, int((np.bincount(of, w, len(names)) >= limit - 1e-6).sum())
