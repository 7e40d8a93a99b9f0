"""Audits of return data; figures are rounded half to even."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Thresholds and percentiles of the report; the status words below are fixed too.
THRESHOLDS = (0.10, 0.20, 0.30, 0.50, 0.75, 1.0)
PERCENTILES = (0.1, 1, 5, 25, 50, 75, 95, 99, 99.9)


#: Splits that adjusted prices must not show, as (ticker, ex-date, ratio).
KNOWN_SPLITS = (
    ("AAPL", "2020-08-31", "4:1"), ("TSLA", "2020-08-31", "5:1"), ("AMZN", "2022-06-06", "20:1"), ("GOOG", "2022-07-18", "20:1"), ("GOOGL", "2022-07-18", "20:1"),
    ("NVDA", "2021-07-20", "4:1"), ("NVDA", "2024-06-10", "10:1"), ("TSLA", "2022-08-25", "3:1"), ("SHW", "2024-09-17", "4:1"),
)
#: Fixed value: tickers of the 2008 crisis, whose presence says whether a universe forgets those who failed.
CRISIS_TICKERS = ("LEH", "BSC", "WM", "WAMU", "AIG", "GM", "C", "BAC", "FNM", "FRE", "MER", "WB", "CFC")


def known_splits(spark: SparkSession) -> DataFrame:
    """(ticker, event_date, ratio)."""
    return spark.createDataFrame(KNOWN_SPLITS, "ticker string, day string, ratio string").select("ticker", F.to_date("day").alias("event_date"), "ratio")


def finite(returns: DataFrame, c: str = "log_ret") -> DataFrame:
    return returns.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def distribution(returns: DataFrame) -> DataFrame:
    """One row of counts, moments (skewness and kurtosis as sample estimates), quantiles and counts beyond thresholds."""
    r = finite(returns)
    x = F.col("log_ret")
    n = F.count("*").cast("double")
    name = lambda p: f"p{p:g}".replace(".", "_")
    return r.agg(
        F.count("*").alias("n_observations"), F.countDistinct("ticker").alias("n_tickers"), F.countDistinct("date").alias("n_days"),
        F.bround(F.avg(x), 8).alias("mean"), F.bround(F.stddev_pop(x), 6).alias("std"), F.bround(F.min(x), 6).alias("min"), F.bround(F.max(x), 6).alias("max"),
        *[F.bround(F.percentile(x, p / 100), 6).alias(name(p)) for p in PERCENTILES],
        F.bround(F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2), 4).alias("skewness"),
        F.bround((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6), 4).alias("kurtosis"),
        *[F.count_if(F.abs(x) > t).alias(f"gt_{t:.2f}".replace(".", "_")) for t in THRESHOLDS],
    )


def clipping_impact(returns: DataFrame, bound: float = 0.5) -> DataFrame:
    r = finite(returns)
    x, out = F.col("log_ret"), F.abs("log_ret") > bound
    clipped = F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))
    return r.agg(
        F.count_if(out).alias("n_clipped"), F.bround(F.lit(100.0) * F.count_if(out) / F.count("*"), 6).alias("pct_clipped"), F.countDistinct(F.when(out, F.col("ticker"))).alias("n_tickers_affected"),
        F.bround(F.avg(x), 8).alias("mean_before"), F.bround(F.avg(clipped), 8).alias("mean_after"), F.bround(F.stddev_pop(x), 6).alias("std_before"), F.bround(F.stddev_pop(clipped), 6).alias("std_after"),
    )


def consecutive_extremes(returns: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Pairs of a ticker's successive returns (missing days skipped) that are both beyond the threshold."""
    w = Window.partitionBy("ticker").orderBy("date")
    p = returns.select("ticker", F.col("date").alias("date2"), F.col("log_ret").alias("r2"), F.lag("date").over(w).alias("date1"), F.lag("log_ret").over(w).alias("r1"))
    return p.where((F.abs("r1") > threshold) & (F.abs("r2") > threshold)).select("ticker", "date1", "date2", F.bround("r1", 4).alias("return1"), F.bround("r2", 4).alias("return2"))


def event_check(events: DataFrame, returns: DataFrame, tolerance: int = 5, normal: float = 0.15) -> DataFrame:
    """The return on each event's date, or else on the first day with one within tolerance days: PASS if it is normal.

    A forward as-of join: each event is spread over its few candidate days, so that it is a hash join.
    """
    e = events.withColumn("date", F.explode(F.sequence("event_date", F.date_add("event_date", tolerance))))
    hit = e.join(returns.select("ticker", "date", "log_ret"), ["ticker", "date"]).groupBy("ticker", "event_date").agg(F.min("date").alias("actual_date"), F.min_by("log_ret", "date").alias("r"))
    out = events.join(hit, ["ticker", "event_date"], "left")
    status = F.when(F.col("r").isNull(), "DATE_NOT_FOUND").when(F.abs("r") < normal, "PASS").otherwise("FAIL_SPIKE")
    return out.select("ticker", "event_date", "actual_date", F.bround("r", 6).alias("return_on_date"), status.alias("status"))


def split_audit(events: DataFrame, returns: DataFrame) -> DataFrame:
    """event_check() of events (ticker, event_date, ratio), with NO_DATA for tickers that have no returns at all."""
    known = returns.select("ticker").distinct().withColumn("_known", F.lit(True))
    out = event_check(events.select("ticker", "event_date"), returns).join(events, ["ticker", "event_date"]).join(known, "ticker", "left")
    return out.withColumn("status", F.when(F.col("_known"), F.col("status")).otherwise("NO_DATA")).drop("_known")


def split_verdict(audit: DataFrame) -> DataFrame:
    """(splits_checked, data_available, passed, failed, verdict) of split_audit(): a pass needs data, and no spike in it."""
    a = audit.agg(F.count("*").alias("splits_checked"), F.count_if(F.col("status").isin("PASS", "FAIL_SPIKE")).alias("data_available"), F.count_if(F.col("status") == "PASS").alias("passed"))
    a = a.withColumn("failed", F.col("data_available") - F.col("passed"))
    return a.withColumn("verdict", F.when((F.col("data_available") > 0) & (F.col("failed") == 0), "PASS").otherwise("FAIL"))


def presence(names: DataFrame, prices: DataFrame, embedded: DataFrame, members: DataFrame) -> DataFrame:
    """Of each of names (ticker): whether it has prices and embeddings and was ever a member (rebal_date, ticker), its last price date, first and last quarter and their number."""
    last = prices.where("close IS NOT NULL").groupBy("ticker").agg(F.max("date").alias("last_price_date"))
    e = embedded.select("ticker").distinct().withColumn("_e", F.lit(True))
    m = members.groupBy("ticker").agg(F.min("rebal_date").alias("first_in_universe"), F.max("rebal_date").alias("last_in_universe"), F.count("*").alias("quarters_in_universe"))
    out = names.select("ticker").distinct()
    for other in (last, e, m):
        out = out.join(other, "ticker", "left")
    return out.select("ticker", F.col("last_price_date").isNotNull().alias("has_prices"), F.coalesce("_e", F.lit(False)).alias("has_embeddings"), F.col("first_in_universe").isNotNull().alias("ever_in_universe"), "last_price_date", "first_in_universe", "last_in_universe", F.coalesce("quarters_in_universe", F.lit(0)).alias("quarters_in_universe"))
