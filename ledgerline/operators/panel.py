"""Price panels in long form: (ticker, date, close, volume) rows; a missing row is a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def close_column(prices: DataFrame) -> DataFrame:
    """prices with close taken from adj_close where there is no close column."""
    return prices if "close" in prices.columns else prices.withColumnRenamed("adj_close", "close")


def calendar(prices: DataFrame) -> DataFrame:
    """(date, date_idx from 0) over the union of all tickers' dates; one row a day, so one task numbers them."""
    return prices.select("date").distinct().withColumn("date_idx", F.row_number().over(Window.orderBy("date")) - 1)


def clip(r: Column, bound: float | None) -> Column:
    """r within plus and minus bound; null stays null (least and greatest alone would not keep it)."""
    return r if bound is None else F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(bound)), F.lit(-bound)))


def safe_log_ratio(now: Column, before: Column) -> Column:
    """ln(now / before) with the limits for zeros, null where it is undefined."""
    return (
        F.when((now > 0) & (before > 0), F.ln(now / before))
        .when((now == 0) & (before > 0), F.lit(float("-inf")))
        .when((now > 0) & (before == 0), F.lit(float("inf")))
    )


def period_ends(prices: DataFrame, frequency: str) -> DataFrame:
    """Last close of each ticker and period: weeks end on Friday, months on their last day; date_idx counts periods."""
    if frequency == "weekly":
        end = F.next_day(F.date_sub("date", 1), "FRI")
        number = F.expr("CAST(datediff(date, DATE'1970-01-02') / 7 AS INT)")
    elif frequency == "monthly":
        end, number = F.last_day("date"), F.expr("year(date) * 12 + month(date)")
    else:
        raise ValueError(f"unknown frequency: {frequency}")
    p = prices.where("close IS NOT NULL").groupBy("ticker", end.alias("end")).agg(F.max_by("close", "date").alias("close"))
    return p.withColumnRenamed("end", "date").withColumn("date_idx", number)


def log_returns(prices: DataFrame, frequency: str = "daily", clip_bound: float | None = 0.5) -> DataFrame:
    """(ticker, date, date_idx, log_ret): defined only where the ticker also has a close in the period just before.

    Days come from the union calendar: after a gap both the missing day and the next have no return. date_idx of daily
    returns is the place in that calendar, which starts at 0 with a day that never has a return.
    """
    prices = close_column(prices)
    if frequency == "daily":
        p = prices.where("close IS NOT NULL").select("ticker", "date", "close").join(F.broadcast(calendar(prices)), "date")
    else:
        p = period_ends(prices, frequency)
    w = Window.partitionBy("ticker").orderBy("date_idx")
    p = p.select("ticker", "date", "date_idx", "close", F.lag("close").over(w).alias("before"), F.lag("date_idx").over(w).alias("before_idx"))
    p = p.where("date_idx - before_idx = 1").select("ticker", "date", "date_idx", clip(safe_log_ratio(F.col("close"), F.col("before")), clip_bound).alias("log_ret"))
    return p.where("log_ret IS NOT NULL")


def simple_returns(returns: DataFrame) -> DataFrame:
    return returns.withColumn("ret", F.exp("log_ret") - 1).drop("log_ret")


def dollar_volume(prices: DataFrame) -> DataFrame:
    """(ticker, date, dv): close times volume; zero volume is missing."""
    p = close_column(prices).withColumn("dv", F.col("close") * F.expr("nullif(volume, 0)"))
    return p.where("dv IS NOT NULL").select("ticker", "date", "dv")


def drop_empty_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop("all", subset=columns)
