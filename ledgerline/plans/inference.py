"""Queries of statistical tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.stats import normal_quantile, parametric_var
from ledgerline.operators import inference, panel, rank
from ledgerline.plans import market
from ledgerline.plans import tables as t
from ledgerline.plans.registry import query, rounded

ALPHA = 0.05
Z = normal_quantile(ALPHA)


def brand_returns(spark: SparkSession, d: str) -> DataFrame:
    """Simple returns with tickers as strategies."""
    return panel.simple_returns(t.returns(spark, d)).select(F.col("ticker").alias("strategy"), "date", "ret")


def violations(spark: SparkSession, d: str) -> DataFrame:
    """(strategy, date, hit): losses beyond the Gaussian value at risk of each ticker's own volatility."""
    r = brand_returns(spark, d)
    v = r.groupBy("strategy").agg(parametric_var(F.stddev_samp("ret"), ALPHA).alias("var"))
    return r.join(F.broadcast(v), "strategy").select("strategy", "date", (F.col("ret") < -F.col("var")).alias("hit"))


_HITS = f"""sr AS (SELECT ticker AS strategy, date, exp(log_ret) - 1 AS ret FROM ret), vr AS (SELECT strategy, -({Z!r} * stddev_samp(ret)) AS v FROM sr GROUP BY 1),
hits AS (SELECT strategy, date, ret < -v AS hit FROM sr JOIN vr USING (strategy)), hw AS (SELECT *, lag(hit) OVER (PARTITION BY strategy ORDER BY date) AS was FROM hits),
tr AS (SELECT strategy, count(*) AS n, CAST(count_if(hit) AS BIGINT) AS v, CAST(count_if(NOT was AND NOT hit) AS BIGINT) AS n00, CAST(count_if(NOT was AND hit) AS BIGINT) AS n01, CAST(count_if(was AND NOT hit) AS BIGINT) AS n10, CAST(count_if(was AND hit) AS BIGINT) AS n11 FROM hw GROUP BY 1)"""
_B = (t.PX, t.CAL, t.RET)


@query("christoffersen_counts", t.sql(*_B, _HITS, "SELECT strategy, n, v, n00, n01, n10, n11 FROM tr"))
def christoffersen_counts(spark: SparkSession, d: str) -> DataFrame:
    return inference.transitions(violations(spark, d), ["strategy"])


_LR = f"""lr AS (SELECT *, CASE WHEN v = 0 THEN -2 * n * ln(1 - {ALPHA}) ELSE -2 * (v * ln({ALPHA}) + (n - v) * ln(1 - {ALPHA}) - v * ln(v::DOUBLE / n) - (n - v) * ln(1 - v::DOUBLE / n)) END AS lr_uc,
 (n01 + n11)::DOUBLE / (n00 + n01 + n10 + n11) AS p, n01::DOUBLE / (n00 + n01) AS p01, n11::DOUBLE / (n10 + n11) AS p11 FROM tr),
li AS (SELECT *, CASE WHEN n01 = 0 OR n10 = 0 OR n00 + n01 = 0 OR n10 + n11 = 0 THEN 0 ELSE -2 * (n00 * ln(1 - p) + n01 * ln(p) + n10 * ln(1 - p) + CASE WHEN n11 = 0 THEN 0 ELSE n11 * ln(p) - n11 * ln(p11) END - n00 * ln(1 - p01) - n01 * ln(p01) - n10 * ln(1 - p11)) END AS lr_ind FROM lr)"""


@query("kupiec_christoffersen", t.sql(*_B, _HITS, _LR, "SELECT strategy, n, v, round(lr_uc, 6) AS lr_uc, round(lr_ind, 6) AS lr_ind, round(lr_uc + lr_ind, 6) AS lr_cc FROM li"))
def kupiec_christoffersen(spark: SparkSession, d: str) -> DataFrame:
    c = inference.coverage(inference.transitions(violations(spark, d), ["strategy"]), ALPHA)
    return rounded(c.select("strategy", "n", "v", "lr_uc", "lr_ind", "lr_cc"))


@query("coverage_p_values")
def coverage_p_values(spark: SparkSession, d: str) -> DataFrame:
    c = inference.coverage(inference.transitions(violations(spark, d), ["strategy"]), ALPHA)
    return rounded(inference.with_p_values(c).select("strategy", "p_uc", "p_cc"))


@query("lo_eta", t.sql(*_B, """sr AS (SELECT ticker AS strategy, log_ret, exp(log_ret) - 1 AS ret, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM ret),
ks AS (SELECT unnest(generate_series(1, 20)) AS k), rh AS (SELECT a.strategy, k, corr(a.ret, b.ret) AS rho FROM sr a JOIN ks ON true JOIN sr b ON b.strategy = a.strategy AND b.i = a.i - k GROUP BY ALL)""", "SELECT strategy, round(sqrt(1 + 2 * sum((1 - k / 21.0) * rho)), 6) AS eta FROM rh GROUP BY 1"))
def lo_eta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.lo_correction(brand_returns(spark, d), 20))


@query("newey_west_tstat", t.sql(*_B, """sr AS (SELECT ticker AS strategy, date, exp(log_ret) - 1 AS x FROM ret), se AS (SELECT *, x - avg(x) OVER (PARTITION BY strategy) AS e FROM sr),
sg AS (SELECT *, e * lag(e, 1) OVER w AS g1, e * lag(e, 2) OVER w AS g2, e * lag(e, 3) OVER w AS g3, e * lag(e, 4) OVER w AS g4 FROM se WINDOW w AS (PARTITION BY strategy ORDER BY date))""", "SELECT strategy, round(avg(x), 8) AS mean, round(avg(x) / sqrt((sum(e * e) + 2 * (0.8 * sum(g1) + 0.6 * sum(g2) + 0.4 * sum(g3) + 0.2 * sum(g4))) / count(*) / count(*)), 5) AS t, count(*) AS n FROM sg GROUP BY 1"))
def newey_west_tstat(spark: SparkSession, d: str) -> DataFrame:
    r = inference.newey_west(brand_returns(spark, d), "strategy", "ret", "date")
    return r.select("strategy", F.round("mean", 8).alias("mean"), F.round("t", 5).alias("t"), "n")


@query("block_sums", t.sql(*_B, "sr AS (SELECT ticker AS strategy, exp(log_ret) - 1 AS ret, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM ret)", "SELECT strategy, i // 63 AS block_no, round(sum(ret), 6) AS s, count(*) AS n FROM sr GROUP BY ALL"))
def block_sums(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.block_sums(brand_returns(spark, d)))


_BETAS = "bt AS (SELECT ticker, round(abs(regr_slope(exp(log_ret) - 1, b)) / 10, 9) AS p_value, CASE WHEN ends_with(ticker, '1') THEN 'x' ELSE 'y' END AS family FROM ret JOIN mkt USING (date) GROUP BY 1)"


@query("bh_fdr", t.sql(*_B, market._MARKET, _BETAS, "rk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value) AS r, count(*) OVER (PARTITION BY family) AS m FROM bt)", "SELECT family, ticker, p_value, round(least(min(p_value * m / r) OVER (PARTITION BY family ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1), 8) AS q_value FROM rk"))
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    from ledgerline.operators.metrics import capm_beta

    b = capm_beta(panel.simple_returns(t.returns(spark, d)), market.market(spark, d))
    tests = b.select(F.when(F.col("ticker").endswith("1"), "x").otherwise("y").alias("family"), "ticker", F.round(F.abs("beta") / 10, 9).alias("p_value"))
    q = rank.benjamini_hochberg(tests, ["family"])
    return q.select("family", "ticker", "p_value", F.round("q_value", 8).alias("q_value"))


_FACTORS = "fac AS (SELECT date, avg(exp(log_ret) - 1) AS mkt, avg(CASE WHEN sector = '1' THEN exp(log_ret) - 1 END) - avg(CASE WHEN sector = '2' THEN exp(log_ret) - 1 END) AS spread FROM ret LEFT JOIN sector USING (ticker) GROUP BY 1)"


def factors(spark: SparkSession, d: str) -> DataFrame:
    """(date, mkt, spread): the market's mean and the difference of two sectors' means."""
    r = panel.simple_returns(t.returns(spark, d)).join(F.broadcast(t.sectors(spark, d)), "ticker", "left")
    of = lambda s: F.avg(F.when(F.col("sector") == s, F.col("ret")))
    return r.groupBy("date").agg(F.avg("ret").alias("mkt"), (of("1") - of("2")).alias("spread"))


@query("ff_regression", t.sql(*_B, t.SECTOR, _FACTORS, "fj AS (SELECT ticker AS strategy, exp(log_ret) - 1 AS y, mkt AS x1, spread AS x2 FROM ret JOIN fac USING (date))", "fm AS (SELECT strategy, count(*) AS n, covar_pop(y, x1) AS a1, covar_pop(y, x2) AS a2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS v12, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM fj GROUP BY 1)",
  "fb AS (SELECT *, (a1 * v2 - a2 * v12) / (v1 * v2 - v12 * v12) AS b1, (a2 * v1 - a1 * v12) / (v1 * v2 - v12 * v12) AS b2 FROM fm)", "SELECT strategy, 'alpha' AS term, round(my - b1 * m1 - b2 * m2, 6) AS beta, n FROM fb UNION ALL SELECT strategy, 'mkt', round(b1, 6), n FROM fb UNION ALL SELECT strategy, 'spread', round(b2, 6), n FROM fb"))
def ff_regression(spark: SparkSession, d: str) -> DataFrame:
    r = inference.factor_regression(brand_returns(spark, d), factors(spark, d), ["mkt", "spread"], rf=None)
    return rounded(r.select("strategy", "term", "beta", "n"))


@query("ff_regression_hac")
def ff_regression_hac(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.factor_regression(brand_returns(spark, d), factors(spark, d), ["mkt", "spread"], rf=None))


PAIRS = [("Brand#1", "Brand#2"), ("Brand#3", "Brand#4"), ("Brand#5", "Brand#6")]


@query("block_permutation_bootstrap")
def block_permutation_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.pair_tests(brand_returns(spark, d), PAIRS))


@query("block_sensitivity")
def block_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.pair_tests(brand_returns(spark, d), PAIRS, block=[42, 63, 126]))
