"""Tests of return series: resampling in grouped tasks, everything else by windows and aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.stats import correlation_p, independence_lr, kupiec_lr, normal_two_sided

_CHUNK = 1000


def permutation_p(a: np.ndarray, b: np.ndarray, block: int = 63, draws: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """(difference of means, p): signs of whole blocks of paired differences at random; of unequal lengths, the pooled series rolled."""
    rng = np.random.RandomState(seed)
    seen = float(np.mean(a) - np.mean(b))
    count = 0
    if len(a) == len(b):
        d = a - b
        n = len(d)
        sums = np.add.reduceat(d, np.arange(0, n, block))
        for at in range(0, draws, _CHUNK):  # draws come in the order of one at a time
            signs = rng.choice([-1, 1], size=(min(_CHUNK, draws - at), len(sums)))
            # means over the signed series itself, so that a tie with the observed difference stays one
            count += int((np.abs(signs @ sums / n) >= abs(seen) - 1e-15).sum())
    else:
        pooled, n, m = np.concatenate([a, b]), len(a) + len(b), len(a)
        run = np.r_[0.0, np.cumsum(np.r_[pooled, pooled])]
        start = (n - rng.randint(0, n, size=draws)) % n
        first = run[start + m] - run[start]
        count = int((np.abs(first / m - (run[n] - first) / (n - m)) >= abs(seen) - 1e-15).sum())
    return seen, (count + 1) / (draws + 1)


def bootstrap_ci(x: np.ndarray, block: int = 63, draws: int = 10_000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float, float]:
    """(mean, low, high) of means over random blocks; a series shorter than a block is its only block."""
    rng = np.random.RandomState(seed)
    n = len(x)
    blocks, size = max(1, n // block), min(block, n)
    run = np.r_[0.0, np.cumsum(x)]
    starts = rng.randint(0, max(1, n - block + 1), size=(draws, blocks))
    means = (run[starts + size] - run[starts]).sum(axis=1) / (blocks * size)
    low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(np.mean(x)), float(low), float(high)


def lo_eta(x: np.ndarray, lags: int = 63) -> float:
    """Factor by which autocorrelation (Bartlett weights) inflates a Sharpe ratio; 1 where it makes no sense."""
    n = len(x)
    if n < lags + 10 or x.var() < 1e-15:
        return 1.0
    total = 0.0
    for k in range(1, lags + 1):
        with np.errstate(all="ignore"):
            r = np.corrcoef(x[k:], x[:-k])[0, 1]
        if np.isfinite(r):
            total += (1 - k / (lags + 1)) * r
    return math.sqrt(1 + 2 * total) if 1 + 2 * total > 0 else 1.0


def hac_ols(y: np.ndarray, x: np.ndarray, lags: int = 10) -> dict[str, np.ndarray | float]:
    """Least squares with a constant; Newey-West errors (Bartlett, no small-sample correction), normal p-values."""
    x = np.c_[np.ones(len(y)), x]
    inverse = np.linalg.inv(x.T @ x)
    b = inverse @ x.T @ y
    u = y - x @ b
    g = x * u[:, None]
    s = g.T @ g
    for k in range(1, min(lags, len(y) - 1) + 1):
        c = g[k:].T @ g[:-k]
        s += (1 - k / (lags + 1)) * (c + c.T)
    se = np.sqrt(np.diag(inverse @ s @ inverse))
    t = b / se
    r2 = 1 - (u @ u) / ((y - y.mean()) ** 2).sum()
    n, p = x.shape
    return {"beta": b, "t": t, "p": np.array([normal_two_sided(v) for v in t]), "r2": float(r2), "r2_adj": float(1 - (1 - r2) * (n - 1) / (n - p)), "n": n}


def newey_west_t(x: np.ndarray, lags: int = 4) -> float:
    """t of the mean of a series."""
    n, e = len(x), x - x.mean()
    v = e @ e / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, min(lags, n - 1) + 1))
    return float(x.mean() / math.sqrt(v / n)) if v > 0 else float("nan")


def pair_tests(returns: DataFrame, pairs: list[tuple[str, str]], block: list[int] | None = None, draws: int = 10_000, seed: int = 42, least: int = 100) -> DataFrame:
    """(a, b, block, n, diff, p_value, mean, ci_low, ci_high) of strategy pairs over their common dates, one grouped task a pair and block size."""
    spark = returns.sparkSession
    p = spark.createDataFrame([(a, b, k) for a, b in pairs for k in (block or [63])], "a string, b string, block int")
    x = returns.select(F.col("strategy").alias("a"), "date", F.col("ret").alias("ra"))
    y = returns.select(F.col("strategy").alias("b"), "date", F.col("ret").alias("rb"))
    j = F.broadcast(p).join(x, "a").join(y, ["b", "date"])

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        if len(g) < least:
            return pd.DataFrame()
        a, b = g["ra"].to_numpy(), g["rb"].to_numpy()
        d, pv = permutation_p(a, b, key[2], draws, seed)
        m, lo, hi = bootstrap_ci(a - b, key[2], draws, seed=seed)
        return pd.DataFrame([(key[0], key[1], key[2], len(g), d, pv, m, lo, hi)], columns=["a", "b", "block", "n", "diff", "p_value", "mean", "ci_low", "ci_high"])

    return j.groupBy("a", "b", "block").applyInPandas(run, "a string, b string, block int, n long, diff double, p_value double, mean double, ci_low double, ci_high double")


def factor_regression(returns: DataFrame, factors: DataFrame, columns: list[str], rf: str | None = "rf", lags: int = 10, least: int = 60) -> DataFrame:
    """(strategy, term, beta, t, p_value, r2, r2_adj, n): excess returns on factors, in one grouped task a strategy; none below least days."""
    j = returns.join(F.broadcast(factors), "date").select("strategy", "date", (F.col("ret") - (F.col(rf) if rf else 0.0)).alias("y"), *columns)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        if len(g) < least:
            return pd.DataFrame()
        g = g.sort_values("date")
        r = hac_ols(g["y"].to_numpy(), g[columns].to_numpy(), lags)
        return pd.DataFrame({"strategy": key[0], "term": ["alpha", *columns], "beta": r["beta"], "t": r["t"], "p_value": r["p"], "r2": r["r2"], "r2_adj": r["r2_adj"], "n": r["n"]})

    return j.groupBy("strategy").applyInPandas(run, "strategy string, term string, beta double, t double, p_value double, r2 double, r2_adj double, n long")


def transitions(violations: DataFrame, by: list[str], order: str = "date") -> DataFrame:
    """(by, n, v, n00, n01, n10, n11) of boolean column hit, along order."""
    w = Window.partitionBy(*by).orderBy(order)
    t = violations.withColumn("_was", F.lag("hit").over(w))
    pair = lambda a, b: F.count_if((F.col("_was") == F.lit(a)) & (F.col("hit") == F.lit(b)))
    return t.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("hit").alias("v"), pair(False, False).alias("n00"), pair(False, True).alias("n01"), pair(True, False).alias("n10"), pair(True, True).alias("n11"))


def coverage(counts: DataFrame, alpha: float) -> DataFrame:
    """counts with lr_uc, lr_ind, lr_cc (null below two observations) of the coverage tests."""
    lr_uc = kupiec_lr(F.col("n"), F.col("v"), alpha)
    lr_ind = independence_lr(F.col("n00"), F.col("n01"), F.col("n10"), F.col("n11"))
    few = F.col("n") < 2
    return counts.select("*", lr_uc.alias("lr_uc"), F.when(~few, lr_ind).alias("lr_ind"), F.when(~few, lr_uc + lr_ind).alias("lr_cc"))


def with_p_values(tests: DataFrame) -> DataFrame:
    """tests with p_uc (1 degree of freedom) and p_cc (2; 1 where independence is degenerate)."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2)), na_action="ignore")

    degenerate = (F.col("n00") + F.col("n01") == 0) | (F.col("n10") + F.col("n11") == 0) | (F.col("n01") == 0) | (F.col("n10") == 0)
    t = tests.withColumn("p_uc", tail("lr_uc"))
    return t.withColumn("p_cc", F.when(degenerate, F.col("p_uc")).otherwise(F.exp(-F.greatest("lr_cc", F.lit(0.0)) / 2)))


def with_rank_p(tests: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    @F.pandas_udf("double")
    def p(r: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(x, int(m)) if x == x else float("nan") for x, m in zip(r, k)])

    return tests.withColumn("p_value", p(F.col(rho), F.col(n)))


def lag_correlations(returns: DataFrame, lags: int = 63) -> DataFrame:
    """(strategy, k, rho): correlation of each series with itself k rows before; rows meet by number in a hash join."""
    r = returns.select("strategy", "ret", F.row_number().over(Window.partitionBy("strategy").orderBy("date")).alias("i"))
    a = r.select("strategy", F.col("ret").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("k"), "i").withColumn("j", F.col("i") - F.col("k"))
    b = r.select("strategy", F.col("ret").alias("y"), F.col("i").alias("j"))
    return a.join(b, ["strategy", "j"]).groupBy("strategy", "k").agg(F.corr("x", "y").alias("rho"))


def lo_correction(returns: DataFrame, lags: int = 63) -> DataFrame:
    """(strategy, eta)."""
    c = lag_correlations(returns, lags).groupBy("strategy").agg(F.sum((1 - F.col("k") / (lags + 1)) * F.coalesce(F.nanvl("rho", F.lit(0.0)), F.lit(0.0))).alias("s"))
    n = returns.groupBy("strategy").agg(F.count("*").alias("n"), F.var_pop("ret").alias("v"))
    e = 1 + 2 * F.col("s")
    return n.join(c, "strategy", "left").select("strategy", F.when((F.col("n") >= lags + 10) & (F.col("v") >= 1e-15) & (e > 0), F.sqrt(e)).otherwise(1.0).alias("eta"))


def newey_west(series: DataFrame, by: str, value: str, order: str, lags: int = 4) -> DataFrame:
    """(by, mean, t, n): Newey-West t of each mean, by lagged products of one window pass."""
    w = Window.partitionBy(by).orderBy(order)
    m = series.select(by, F.col(value).alias("x"), order, F.avg(value).over(Window.partitionBy(by)).alias("m")).withColumn("e", F.col("x") - F.col("m"))
    for k in range(1, lags + 1):
        m = m.withColumn(f"g{k}", F.col("e") * F.lag("e", k).over(w))
    a = m.groupBy(by).agg(F.avg("x").alias("mean"), F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("g0"), *[F.coalesce(F.sum(f"g{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)])
    v = (F.col("g0") + sum((2 * (1 - k / (lags + 1)) * F.col(f"g{k}") for k in range(1, lags + 1)), F.lit(0.0))) / F.col("n")
    return a.select(by, "mean", F.when(v > 0, F.col("mean") / F.sqrt(v / F.col("n"))).alias("t"), "n")


def block_sums(returns: DataFrame, block: int = 63) -> DataFrame:
    """(strategy, block_no, s, n): sums over non-overlapping blocks of rows, which the sign-flip test needs."""
    r = returns.select("strategy", "ret", (F.row_number().over(Window.partitionBy("strategy").orderBy("date")) - 1).alias("i"))
    return r.groupBy("strategy", F.expr(f"i div {block}").alias("block_no")).agg(F.sum("ret").alias("s"), F.count("*").alias("n"))
