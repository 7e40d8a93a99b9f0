"""Point-in-time universes: every window ends strictly before its rebalance date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.calendars import trailing_places


def median_adv(dv: DataFrame, calendar: DataFrame, places: DataFrame, lookback: int = 21) -> DataFrame:
    """(rebal_date, ticker, median_adv): median of the dollar volumes in the last lookback calendar days."""
    w = F.broadcast(trailing_places(places, lookback))
    return dv.join(F.broadcast(calendar), "date").join(w, "date_idx").groupBy("rebal_date", "ticker").agg(F.median("dv").alias("median_adv"))


def completeness(returns: DataFrame, places: DataFrame, lookback: int = 504) -> DataFrame:
    """(rebal_date, ticker, n_ret, n_days): returns in the last lookback days of the return calendar, and its days."""
    w = F.broadcast(trailing_places(places, lookback, first=1))
    days = places.select("rebal_date", F.greatest(F.lit(0), F.least(F.lit(lookback), F.col("t_idx") - 1)).alias("n_days"))
    n = returns.join(w, "date_idx").groupBy("rebal_date", "ticker").agg(F.count("log_ret").alias("n_ret"))
    return n.join(F.broadcast(days), "rebal_date")


def investable(adv: DataFrame, complete: DataFrame, eligible: DataFrame, least_adv: float = 1e6, share: float = 0.8, most: int | None = None) -> DataFrame:
    """(rebal_date, ticker, median_adv): a median of at least least_adv, returns on a share of the days, in eligible (rebal_date, ticker); of them the most liquid, if most bounds them.

    The days needed are truncated to a whole number of days. Ties of liquidity go to the lesser ticker.
    """
    need = F.floor(F.col("n_days") * share)
    u = adv.where(F.col("median_adv") >= least_adv).join(complete.where(F.col("n_ret") >= need).select("rebal_date", "ticker"), ["rebal_date", "ticker"], "left_semi")
    u = u.join(eligible.select("rebal_date", "ticker"), ["rebal_date", "ticker"], "left_semi")
    if most:
        rank = F.row_number().over(Window.partitionBy("rebal_date").orderBy(F.col("median_adv").desc(), "ticker"))
        u = u.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
    return u


def fully_complete(members: DataFrame, complete: DataFrame, share: float = 0.8) -> DataFrame:
    """The second gate: returns over days at least share, not truncated."""
    return members.join(complete.where(F.col("n_ret") / F.col("n_days") >= share).select("rebal_date", "ticker"), ["rebal_date", "ticker"], "left_semi")


def liquid_screen(prices: DataFrame, top_n: int = 2000, days: int = 252, least: int = 126) -> DataFrame:
    """(ticker, adv): mean of close times volume over each ticker's last days rows that have one, best first."""
    p = prices.select("ticker", "date", (F.col("close") * F.col("volume")).alias("x")).where("x IS NOT NULL")
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    a = p.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= days).groupBy("ticker").agg(F.avg("x").alias("adv"), F.count("*").alias("n"))
    return a.where((F.col("n") >= least) & (F.col("adv") > 0)).select("ticker", "adv").orderBy(F.col("adv").desc(), "ticker").limit(top_n)


def entries_exits(members: DataFrame) -> DataFrame:
    """(rebal_date, n_members, entries, exits): changes against the date before; the first date has no entries."""
    dates = members.select("rebal_date").distinct().withColumn("q", F.row_number().over(Window.orderBy("rebal_date")))
    m = members.select("rebal_date", "ticker").join(F.broadcast(dates), "rebal_date")
    w = Window.partitionBy("ticker").orderBy("q")
    m = m.select("ticker", "q", F.lag("q").over(w).alias("before"), F.lead("q").over(w).alias("after"))
    came = m.where("q > 1 AND (before IS NULL OR before < q - 1)").groupBy("q").agg(F.count("*").alias("entries"))
    went = m.where("after IS NULL OR after > q + 1").select((F.col("q") + 1).alias("q")).groupBy("q").agg(F.count("*").alias("exits"))
    sizes = m.groupBy("q").agg(F.count("*").alias("n_members"))
    out = dates.join(sizes, "q").join(came, "q", "left").join(went, "q", "left")
    return out.select("rebal_date", "n_members", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("exits", F.lit(0)).alias("exits"))


def churn_summary(changes: DataFrame) -> DataFrame:
    """Mean, least and most entries and exits, without the first date."""
    first = changes.agg(F.min("rebal_date").alias("first"))
    c = changes.join(F.broadcast(first), F.col("rebal_date") > F.col("first"))
    return c.agg(*[f(k).cast("double").alias(f"{n}_{k}") for k in ("entries", "exits") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def tenure(members: DataFrame) -> DataFrame:
    """(ticker, n_quarters, first_seen, last_seen)."""
    return members.groupBy("ticker").agg(F.count("*").alias("n_quarters"), F.min("rebal_date").alias("first_seen"), F.max("rebal_date").alias("last_seen"))


def last_price_dates(prices: DataFrame) -> DataFrame:
    return prices.where("close IS NOT NULL").groupBy("ticker").agg(F.max("date").alias("last_date"))


def delisted(prices: DataFrame, before: str) -> DataFrame:
    """Tickers whose last price is before a date."""
    return last_price_dates(prices).where(F.col("last_date") < F.lit(before).cast("date"))


#: Returns of a ticker's history below which a bucket ends.
HISTORY = (63, 126, 252)


def history_buckets(complete: DataFrame, bounds: tuple[int, ...] = HISTORY) -> DataFrame:
    """complete (with n_ret over all history) with bucket: the first bound above n_ret, or the open end."""
    n = F.coalesce(F.col("n_ret"), F.lit(2 * bounds[-1]))  # a ticker of unknown history is an old one
    out = F.lit(f">={bounds[-1]}")
    for b in reversed(bounds):
        out = F.when(n < b, F.lit(f"<{b}")).otherwise(out)
    return complete.withColumn("bucket", out)


def with_any_return(returns: DataFrame) -> DataFrame:
    """(ticker, n_ret) of the tickers that have a return at all."""
    return returns.groupBy("ticker").agg(F.count("log_ret").alias("n_ret")).where("n_ret > 0")
