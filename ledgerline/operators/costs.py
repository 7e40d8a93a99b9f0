"""Transaction costs by liquidity tier and volatility regime."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.calendars import trailing_places


class Tier(NamedTuple):
    """What a trade costs, in hundredths of a percent, from a median daily dollar volume on."""

    name: str
    floor: float
    bps: float


#: Names, floors and costs of the tiers.
TIERS = (Tier("large_cap", 500e6, 10.0), Tier("mid_cap", 50e6, 20.0), Tier("small_cap", 0.0, 50.0))


def tier(adv: Column, what: str = "name", tiers: tuple[Tier, ...] = TIERS) -> Column:
    """Name or bps of the first tier (by floor, highest first) that adv reaches; else, and if unknown, of the last."""
    ordered = sorted(tiers, key=lambda t: -t.floor)
    out = F.lit(getattr(ordered[-1], what))
    for t in reversed(ordered):
        out = F.when(adv.isNotNull() & ~F.isnan(adv) & (adv >= t.floor), F.lit(getattr(t, what))).otherwise(out)
    return out


def vol_regime(returns: DataFrame, places: DataFrame, lookback: int = 63, cap: float = 2.0) -> DataFrame:
    """(rebal_date, multiplier): median volatility of the last lookback days over that of all days before, within [1, cap].

    1 where there are fewer than twice lookback days or the baseline is not positive.
    """
    recent = returns.join(F.broadcast(trailing_places(places, lookback, first=1)), "date_idx").groupBy("rebal_date", "ticker").agg(F.stddev_samp("log_ret").alias("v"))
    recent = recent.groupBy("rebal_date").agg(F.median("v").alias("recent"))
    past = history_volatility(returns, places).groupBy("rebal_date").agg(F.median("v").alias("baseline"))
    out = places.join(recent, "rebal_date", "left").join(past, "rebal_date", "left")
    known = (F.col("t_idx") - 1 >= 2 * lookback) & (F.col("baseline") > 0) & F.col("recent").isNotNull()
    return out.select("rebal_date", F.when(known, F.greatest(F.lit(1.0), F.least(F.col("recent") / F.col("baseline"), F.lit(cap)))).otherwise(1.0).alias("multiplier"))


def history_volatility(returns: DataFrame, places: DataFrame) -> DataFrame:
    """(rebal_date, ticker, v): standard deviation of all returns before each date, null for fewer than two.

    Each return counts once, at the first date after it; running sums of a ticker carry it on to the later ones.
    """
    steps = places.withColumn("q", F.row_number().over(Window.orderBy("t_idx", "rebal_date")))  # one row a date
    steps = steps.withColumn("since", F.coalesce(F.lag("t_idx").over(Window.orderBy("q")), F.lit(0)))
    last = steps.agg(F.max("q").alias("last"))
    days = steps.where("t_idx > since").select("q", F.explode(F.sequence("since", F.col("t_idx") - 1)).alias("date_idx"))
    x = F.col("log_ret")
    sums = returns.join(F.broadcast(days), "date_idx").groupBy("ticker", "q").agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    w = Window.partitionBy("ticker").orderBy("q")
    run = sums.crossJoin(F.broadcast(last)).select("ticker", "q", *[F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(c) for c in ("n", "s", "ss")], (F.coalesce(F.lead("q").over(w) - 1, F.col("last"))).alias("upto"))
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))
    run = run.where("n > 1").select("ticker", spread.alias("v"), F.explode(F.sequence("q", "upto")).alias("q"))
    return run.join(F.broadcast(steps.select("q", "rebal_date")), "q").select("rebal_date", "ticker", "v")


def tc_rates(adv: DataFrame, regime: DataFrame, tiers: tuple[Tier, ...] = TIERS) -> DataFrame:
    """(rebal_date, ticker, tc_rate) as decimal fractions."""
    rate = tier(F.col("median_adv"), "bps", tiers) / 10_000.0 * F.col("multiplier")
    return adv.join(F.broadcast(regime), "rebal_date").select("rebal_date", "ticker", rate.alias("tc_rate"))


def multiplier_sweep(rates: DataFrame, factors: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0)) -> DataFrame:
    """rates for each factor, with a column factor."""
    return rates.withColumn("factor", F.explode(F.array(*map(F.lit, factors)))).withColumn("tc_rate", F.col("tc_rate") * F.col("factor"))
