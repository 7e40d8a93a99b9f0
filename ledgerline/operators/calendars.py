"""Rebalance dates, holding periods and quarters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def quarterly_dates(spark: SparkSession, start: date | str, end: date | str) -> DataFrame:
    """(rebal_date): the first days of January, April, July and October within [start, end]."""
    s, e = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    d = spark.range(1).select(F.explode(F.sequence(F.trunc(s, "quarter").cast("date"), e, F.expr("INTERVAL 3 MONTH"))).alias("rebal_date"))
    return d.where(F.col("rebal_date") >= s)


def holding_periods(rebal: DataFrame, end: date | str) -> DataFrame:
    """(rebal_date, period_end): each period ends, exclusively, at the next date; the last at end."""
    w = Window.orderBy("rebal_date")
    return rebal.select("rebal_date", F.coalesce(F.lead("rebal_date").over(w), F.lit(str(end)).cast("date")).alias("period_end"))


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "quarter")


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def date_places(calendar: DataFrame, rebal: DataFrame) -> DataFrame:
    """(rebal_date, t_idx): number of calendar days strictly before each date; both inputs are small (days, dates)."""
    c = calendar.select("date")
    return rebal.join(c, c.date < rebal.rebal_date, "left").groupBy("rebal_date").agg(F.count("date").cast("int").alias("t_idx"))


def trailing_places(places: DataFrame, n: int, first: int = 0) -> DataFrame:
    """(rebal_date, date_idx) of the last n calendar days before each date, none below first: a hash-join key in place of a range join."""
    lo, hi = F.greatest(F.col("t_idx") - n, F.lit(first)), F.col("t_idx") - 1
    return places.where(hi >= lo).select("rebal_date", F.explode(F.sequence(lo, hi)).alias("date_idx"))


def every_kth(dates: DataFrame, step: int, most: int | None = None) -> DataFrame:
    """(rebal_date): the first date and every step-th after it, at most `most` of them; dates are few."""
    d = dates.select("rebal_date").distinct().withColumn("place", F.row_number().over(Window.orderBy("rebal_date")) - 1).where(F.col("place") % step == 0)
    return (d.where(F.col("place") < step * most) if most else d).select("rebal_date")
