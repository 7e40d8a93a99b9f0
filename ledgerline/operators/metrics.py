"""Performance metrics of daily return series (strategy, date, ret)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def drawdowns(returns: DataFrame) -> DataFrame:
    """(strategy, date, cumulative, running_max, drawdown); the peak does not count the capital at the start."""
    w = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = returns.withColumn("cumulative", F.product(1 + F.col("ret")).over(w))
    d = d.withColumn("running_max", F.max("cumulative").over(w))
    return d.select("strategy", "date", "cumulative", "running_max", ((F.col("cumulative") - F.col("running_max")) / F.col("running_max")).alias("drawdown"))


def performance(returns: DataFrame, risk_free_rate: float = 0.0) -> DataFrame:
    """One row a strategy: annualised return and volatility, Sharpe, Sortino, drawdown, Calmar, observations."""
    rf = risk_free_rate / YEAR
    x = F.col("ret") - rf
    a = returns.groupBy("strategy").agg(
        F.avg(x).alias("mean_x"), (F.avg("ret") * YEAR).alias("annualized_return"), (F.stddev_samp(x) * YEAR**0.5).alias("annualized_volatility"),
        (F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2))) * YEAR**0.5).alias("downside"), F.count("*").alias("n_observations"),
    )
    worst = drawdowns(returns).groupBy("strategy").agg(F.min("drawdown").alias("max_drawdown"))
    a = a.join(worst, "strategy")
    excess = F.col("mean_x") * YEAR
    return a.select(
        "strategy", "annualized_return", "annualized_volatility",
        F.when(F.col("annualized_volatility") > 0, excess / F.col("annualized_volatility")).otherwise(0.0).alias("sharpe_ratio"),
        F.when(F.col("downside") > 0, excess / F.col("downside")).otherwise(0.0).alias("sortino_ratio"), "max_drawdown",
        F.when(F.abs("max_drawdown") > 1e-10, F.col("annualized_return") / F.abs("max_drawdown")).otherwise(0.0).alias("calmar_ratio"), "n_observations",
    )


def against_benchmark(returns: DataFrame, benchmark: DataFrame, least: int = 11) -> DataFrame:
    """(strategy, information_ratio, tracking_error, capm_alpha, capm_beta, n_common) where at least that many days match."""
    j = returns.join(benchmark.select("date", F.col("ret").alias("b")), "date").withColumn("active", F.col("ret") - F.col("b"))
    a = j.groupBy("strategy").agg(
        (F.stddev_samp("active") * YEAR**0.5).alias("tracking_error"), (F.avg("active") * YEAR).alias("m"), (F.regr_intercept("ret", "b") * YEAR).alias("capm_alpha"),
        F.regr_slope("ret", "b").alias("capm_beta"), F.count("*").alias("n_common"),
    )
    ratio = F.when(F.col("tracking_error") > 0, F.col("m") / F.col("tracking_error")).otherwise(0.0)
    return a.where(F.col("n_common") >= least).select("strategy", ratio.alias("information_ratio"), "tracking_error", "capm_alpha", "capm_beta", "n_common")


def capm_hac(returns: DataFrame, benchmark: DataFrame, lags: int = 10, least: int = 11) -> DataFrame:
    """(strategy, capm_alpha, capm_alpha_t, capm_alpha_p, capm_beta, n): the regression on the benchmark with Newey-West errors."""
    from ledgerline.operators.inference import factor_regression

    terms = factor_regression(returns, benchmark.select("date", F.col("ret").alias("b")), ["b"], None, lags, least)
    own = lambda term, c: F.max(F.when(F.col("term") == term, F.col(c)))
    return terms.groupBy("strategy").agg((own("alpha", "beta") * YEAR).alias("capm_alpha"), own("alpha", "t").alias("capm_alpha_t"), own("alpha", "p_value").alias("capm_alpha_p"), own("b", "beta").alias("capm_beta"), F.max("n").alias("n"))


def capm_beta(returns: DataFrame, market: DataFrame, key: str = "ticker", least: int = 20) -> DataFrame:
    """(key, beta, n): covariance over variance, null below least rows or if the market hardly varies."""
    j = returns.join(market.select("date", F.col("ret").alias("b")), "date")
    a = j.groupBy(key).agg(F.covar_samp("ret", "b").alias("c"), F.var_samp("b").alias("v"), F.count("*").alias("n"))
    return a.select(key, F.when((F.col("n") >= least) & (F.col("v") >= 1e-12), F.col("c") / F.col("v")).alias("beta"), "n")


def moments(returns: DataFrame) -> DataFrame:
    """(strategy, skewness, excess_kurtosis, jarque_bera, jb_pvalue, var_5, cvar_5, var_1, cvar_1): population moments."""
    q = returns.groupBy("strategy").agg(F.percentile("ret", 0.05).alias("var_5"), F.percentile("ret", 0.01).alias("var_1"), F.skewness("ret").alias("skewness"), F.kurtosis("ret").alias("excess_kurtosis"), F.count("*").alias("n"))
    tail = returns.join(F.broadcast(q.select("strategy", "var_5", "var_1")), "strategy").groupBy("strategy").agg(
        F.avg(F.when(F.col("ret") <= F.col("var_5"), F.col("ret"))).alias("cvar_5"), F.avg(F.when(F.col("ret") <= F.col("var_1"), F.col("ret"))).alias("cvar_1"))
    jb = F.col("n") / 6 * (F.pow("skewness", 2) + F.pow("excess_kurtosis", 2) / 4)
    return q.join(tail, "strategy").select("strategy", "skewness", "excess_kurtosis", jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jb_pvalue"), "var_5", "cvar_5", "var_1", "cvar_1")


def across(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, mean, sd, least, q25, median, q75) of x, of dates for instance; sd is of the population."""
    return rows.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("least"), *[F.percentile(x, q).alias(n) for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])


def crossover(sharpe: DataFrame, rising: str, level: str) -> DataFrame:
    """(crossover): the least lookback at which strategy rising reaches the Sharpe ratio that level has at lookback 0; null if none does."""
    mark = sharpe.where((F.col("strategy") == level) & (F.col("lookback") == 0)).agg(F.max("sharpe_ratio").alias("mark"))
    up = sharpe.where((F.col("strategy") == rising) & (F.col("lookback") > 0)).crossJoin(F.broadcast(mark))  # one row
    return up.agg(F.min(F.when(F.col("sharpe_ratio") >= F.col("mark"), F.col("lookback"))).alias("crossover"))
