"""Walk-forward backtests without a day loop.

A period starts from its target weights, so periods don't wait for each other: the value that a position has before a
day is its target times the product of one plus its earlier returns of the period. The first day uses the targets as they
are; every later day divides by the sum over positions. A missing return adds nothing and moves nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import cut

KEY = ["strategy", "rebal_date"]


def position_days(weights: DataFrame, returns: DataFrame, periods: DataFrame) -> DataFrame:
    """(strategy, rebal_date, date, ticker, weight, x, held): held is the position's value before the day, x its simple return.

    weights: (strategy, rebal_date, ticker, weight); returns: (ticker, date, log_ret); periods: (rebal_date, period_end).
    Each day that any ticker has a return counts for all positions of its period.
    """
    days = returns.select("date").distinct()
    days = days.join(F.broadcast(periods), (F.col("date") >= F.col("rebal_date")) & (F.col("date") < F.col("period_end"))).select("rebal_date", "date")
    grid = weights.join(F.broadcast(days), "rebal_date")
    r = returns.select("ticker", "date", (F.exp("log_ret") - 1).alias("x"))
    p = grid.join(r, ["ticker", "date"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    w = Window.partitionBy(*KEY, "ticker").orderBy("date")
    grown = F.product(1 + F.col("x")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    p = p.withColumn("grown", grown)
    return p.select(*KEY, "date", "ticker", "weight", "x", (F.col("weight") * F.coalesce(F.lag("grown").over(w), F.lit(1.0))).alias("held"), (F.col("weight") * F.col("grown")).alias("after"))


def drifted(positions: DataFrame) -> DataFrame:
    """(strategy, rebal_date, ticker, drifted): weights at the end of each period, sum 1 (as they are if the sum isn't positive)."""
    last = positions.groupBy(*KEY, "ticker").agg(F.max_by("after", "date").alias("after"))
    total = F.sum("after").over(Window.partitionBy(*KEY))
    return last.select(*KEY, "ticker", F.when(total > 0, F.col("after") / total).otherwise(F.col("after")).alias("drifted"))


def turnover_costs(weights: DataFrame, drift: DataFrame, rates: DataFrame | None = None, flat_bps: float = 10.0) -> DataFrame:
    """(strategy, rebal_date, turnover, tc) of each period that has days; drift is that of the period with days before it.

    The first period costs the flat rate once, whatever the rates of single tickers are.
    """
    flat = flat_bps / 10_000.0
    live = drift.select(*KEY).distinct()
    w = Window.partitionBy("strategy").orderBy("rebal_date")
    live = live.withColumn("before", F.lag("rebal_date").over(w))
    target = weights.join(live, KEY).select("strategy", "rebal_date", "ticker", F.col("weight").alias("target"))
    prev = live.where("before IS NOT NULL").select("strategy", "rebal_date", "before").join(drift.select("strategy", F.col("rebal_date").alias("before"), "ticker", "drifted"), ["strategy", "before"]).drop("before")
    both = target.join(prev, ["strategy", "rebal_date", "ticker"], "full_outer")
    moved = F.abs(F.coalesce("target", F.lit(0.0)) - F.coalesce("drifted", F.lit(0.0)))
    if rates is not None:
        both = both.join(rates, ["rebal_date", "ticker"], "left").withColumn("rate", F.coalesce("tc_rate", F.lit(flat)))
    else:
        both = both.withColumn("rate", F.lit(flat))
    sums = both.groupBy(*KEY).agg(F.sum(moved).alias("turnover"), F.sum(moved * F.col("rate")).alias("cost"))
    first = F.col("before").isNull()
    return live.join(sums, KEY).select(*KEY, F.when(~first, F.col("turnover")).alias("turnover"), F.when(first, F.lit(flat)).otherwise(F.col("cost")).alias("tc"))


def daily_returns(positions: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """(strategy, rebal_date, date, ret): the portfolio's simple return, less the period's costs on its first day."""
    d = positions.groupBy(*KEY, "date").agg(F.sum(F.col("held") * F.col("x")).alias("gain"), F.sum("held").alias("value"))
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("date")) == 1
    d = d.withColumn("first", first)
    raw = F.when(F.col("first") | (F.col("value") <= 0), F.col("gain")).otherwise(F.col("gain") / F.col("value"))
    if costs is None:
        return d.select(*KEY, "date", raw.alias("ret"))
    d = d.join(costs.select(*KEY, "tc"), KEY, "left")
    return d.select(*KEY, "date", (raw - F.when(F.col("first"), F.coalesce("tc", F.lit(0.0))).otherwise(0.0)).alias("ret"))


def average_turnover(weights: DataFrame) -> DataFrame:
    """(strategy, avg_turnover): mean absolute change from target to target over consecutive rebalances."""
    dates = weights.select(*KEY).distinct().withColumn("before", F.lag("rebal_date").over(Window.partitionBy("strategy").orderBy("rebal_date"))).where("before IS NOT NULL")
    now = weights.join(dates, KEY).select(*KEY, "ticker", F.col("weight").alias("now"))
    then = dates.join(weights.select("strategy", F.col("rebal_date").alias("before"), "ticker", F.col("weight").alias("then")), ["strategy", "before"]).drop("before")
    both = now.join(then, [*KEY, "ticker"], "full_outer")
    t = both.groupBy(*KEY).agg(F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("then", F.lit(0.0)))).alias("t"))
    return t.groupBy("strategy").agg(F.avg("t").alias("avg_turnover"))


def run(weights: DataFrame, returns: DataFrame, periods: DataFrame, rates: DataFrame | None = None, flat_bps: float = 10.0) -> DataFrame:
    """(strategy, rebal_date, date, ret) of whole backtests, with costs from drifted weights."""
    positions = cut(position_days(weights, returns, periods))  # costs and days both read it
    return daily_returns(positions, turnover_costs(weights, drifted(positions), rates, flat_bps))
