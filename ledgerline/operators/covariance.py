"""Covariances as pair tables: what SQL can say about them without a matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.calendars import trailing_places
from ledgerline.operators.gram import pair_sums


def windowed(returns: DataFrame, places: DataFrame, lookback: int) -> DataFrame:
    """(rebal_date, ticker, date_idx, x) of the last lookback days before each date."""
    w = F.broadcast(trailing_places(places, lookback, first=1))
    return returns.join(w, "date_idx").select("rebal_date", "ticker", "date_idx", F.col("log_ret").alias("x"))


def sample_cov(window: DataFrame) -> DataFrame:
    """(rebal_date, a, b, n, cov), a <= b, with missing returns as zero and n - 1 below.

    Pairs that have no day in common have no row; sums of each ticker stand for the days that one lacks.
    """
    days = window.groupBy("rebal_date").agg(F.countDistinct("date_idx").alias("n"))
    sums = window.groupBy("rebal_date", "ticker").agg(F.sum("x").alias("s"))
    out = pair_sums(window).select("rebal_date", "a", "b", "xy").join(F.broadcast(days), "rebal_date")
    out = out.join(sums.select("rebal_date", F.col("ticker").alias("a"), F.col("s").alias("sa")), ["rebal_date", "a"]).join(sums.select("rebal_date", F.col("ticker").alias("b"), F.col("s").alias("sb")), ["rebal_date", "b"])
    return out.select("rebal_date", "a", "b", "n", ((F.col("xy") - F.col("sa") * F.col("sb") / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def realized_corr(window: DataFrame) -> DataFrame:
    """(rebal_date, a, b, corr, n), a < b, over the days on which both have a return; null where one doesn't vary on them."""
    s = pair_sums(window, shifted=True, same=False)
    va, vb = F.col("xxa") - F.col("xa") ** 2 / F.col("n"), F.col("xxb") - F.col("xb") ** 2 / F.col("n")
    # what rounding leaves of no variance is none
    flat = (va <= 1e-14 * F.col("xxa")) | (vb <= 1e-14 * F.col("xxb"))
    corr = (F.col("xy") - F.col("xa") * F.col("xb") / F.col("n")) / F.sqrt(va * vb)
    return s.select("rebal_date", "a", "b", F.when(~flat, corr).alias("corr"), "n")


def lw_shrinkage(window: DataFrame) -> DataFrame:
    """(rebal_date, shrinkage): the Ledoit-Wolf coefficient toward a scaled identity, missing returns as zero.

    With c the deviations from each ticker's mean over all n days and G their products summed over days, it is the
    spread of the daily products around their mean, relative to the distance of G / n from the target. Both are sums that
    need neither a matrix nor a row for a day that a ticker lacks: what absent days and pairs that never meet add
    follows from the tickers' means.
    """
    days = window.groupBy("rebal_date").agg(F.countDistinct("date_idx").cast("double").alias("n"), F.countDistinct("ticker").cast("double").alias("p"))
    means = window.groupBy("rebal_date", "ticker").agg(F.sum("x").alias("s")).join(F.broadcast(days), "rebal_date").withColumn("m", F.col("s") / F.col("n"))
    flat = means.groupBy("rebal_date").agg(F.sum(F.col("m") ** 2).alias("m2"))
    # a day's squared length: of those present (x - m)^2, of the others m^2
    lengths = window.join(means.select("rebal_date", "ticker", "m"), ["rebal_date", "ticker"]).groupBy("rebal_date", "date_idx").agg(F.sum(F.col("x") * F.col("x") - 2 * F.col("x") * F.col("m")).alias("d"))
    lengths = lengths.join(F.broadcast(flat), "rebal_date").withColumn("length", F.col("d") + F.col("m2"))
    daily = lengths.groupBy("rebal_date").agg(F.sum(F.col("length") ** 2).alias("fourth"), F.sum("length").alias("second"))
    side = lambda c: means.select("rebal_date", F.col("ticker").alias(c), F.col("m").alias(f"m{c}"))
    pairs = pair_sums(window).select("rebal_date", "a", "b", "xy").join(F.broadcast(days), "rebal_date").join(side("a"), ["rebal_date", "a"]).join(side("b"), ["rebal_date", "b"])
    alone = F.col("n") * F.col("ma") * F.col("mb")  # minus this is the product of a pair that never meets
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    more = pairs.groupBy("rebal_date").agg(F.sum(twice * ((F.col("xy") - alone) ** 2 - alone**2)).alias("more"))
    r = days.join(daily, "rebal_date").join(flat, "rebal_date").join(more, "rebal_date")
    r = r.withColumns({"scale": F.col("second") / F.col("n") / F.col("p"), "norm2": (F.col("more") + (F.col("n") * F.col("m2")) ** 2) / F.col("n") ** 2})
    distance = F.col("norm2") / F.col("p") - F.col("scale") ** 2
    spread = F.least((F.col("fourth") / F.col("n") - F.col("norm2")) / F.col("p") / F.col("n"), distance)
    return r.select("rebal_date", F.when(spread == 0, 0.0).otherwise(spread / distance).alias("shrinkage"))


def sector_cov(sigmas: DataFrame, sectors: DataFrame, within: float = 0.5, cross: float = 0.2) -> DataFrame:
    """(rebal_date, a, b, cov), a <= b: constant correlation inside and across sectors; an unknown sector is one of its own."""
    s = sigmas.join(F.broadcast(sectors), "ticker", "left").select("rebal_date", "ticker", "sigma", F.coalesce("sector", F.concat(F.lit("_unknown_"), "ticker")).alias("sec"))
    a = s.select("rebal_date", F.col("ticker").alias("a"), F.col("sigma").alias("va"), F.col("sec").alias("ga"))
    b = s.select("rebal_date", F.col("ticker").alias("b"), F.col("sigma").alias("vb"), F.col("sec").alias("gb"))
    rho = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("ga") == F.col("gb"), within).otherwise(cross)
    return a.join(b, "rebal_date").where("a <= b").select("rebal_date", "a", "b", (rho * F.col("va") * F.col("vb")).alias("cov"))


def sigmas(window: DataFrame) -> DataFrame:
    return window.groupBy("rebal_date", "ticker").agg(F.stddev_samp("x").alias("sigma"))


def frobenius_products(cov: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(rebal_date, i, j, aij, bi) sums over all pairs of (Ti - S)(Tj - S) and (Ti - S) S, for the calibration of several targets."""
    full = lambda c, v: c.select("rebal_date", "a", "b", F.col("cov").alias(v)).unionByName(c.where("a <> b").select("rebal_date", F.col("b").alias("a"), F.col("a").alias("b"), F.col("cov").alias(v)))
    j = full(cov, "s")
    for name, c in targets.items():
        j = j.join(full(c, name), ["rebal_date", "a", "b"])
    names = list(targets)
    d = {n: F.col(n) - F.col("s") for n in names}
    aggs = [F.sum(d[x] * d[y]).alias(f"{x}_{y}") for k, x in enumerate(names) for y in names[k:]] + [F.sum(d[x] * F.col("s")).alias(f"{x}_s") for x in names]
    return j.groupBy("rebal_date").agg(*aggs)


def ew_portfolio_vol(cov: DataFrame) -> DataFrame:
    """(rebal_date, vol): daily volatility of equal weights."""
    n = cov.where("a = b").groupBy("rebal_date").agg(F.count("*").alias("p"))
    s = cov.groupBy("rebal_date").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise(2 * F.col("cov"))).alias("s"))
    return s.join(n, "rebal_date").select("rebal_date", F.sqrt(F.greatest(F.col("s") / (F.col("p") * F.col("p")), F.lit(0.0))).alias("vol"))
