"""Exact values of the backtest against a day-by-day loop, and of universes, costs and panels on small panels."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import backtest, calendars, costs, metrics, panel, universe

DAYS = [date(2022, 1, 3) + timedelta(days=k) for k in range(8)]


def loop(weights, rets, periods, bps):
    """What a day loop gives: (date, return)."""
    out, prev = [], None
    for t, end in periods:
        w = dict(weights[t])
        days = [d for d in DAYS if t <= d < end and any((d, k) in rets for k in "ABC")]
        if prev is None:
            tc = bps / 1e4
        else:
            tc = sum(abs(w.get(k, 0) - prev.get(k, 0)) for k in {*w, *prev}) * bps / 1e4
        if not days:
            continue
        for i, d in enumerate(days):
            r = {k: math.exp(rets[d, k]) - 1 for k in w if (d, k) in rets}
            out.append((d, sum(w[k] * r[k] for k in r) - (tc if i == 0 else 0)))
            w = {k: v * (1 + r.get(k, 0)) for k, v in w.items()}
            total = sum(w.values())
            w = {k: v / total for k, v in w.items()} if total > 0 else w
        prev = w
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_backtest_equals_day_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rets = {(d, k): float(rng.normal(0, 0.02)) for d in DAYS for k in "ABC" if rng.random() > 0.2}
    periods = [(DAYS[0], DAYS[3]), (DAYS[3], DAYS[6]), (DAYS[6], DAYS[7] + timedelta(days=1))]
    weights = {DAYS[0]: {"A": 0.6, "B": 0.4}, DAYS[3]: {"B": 0.5, "C": 0.7}, DAYS[6]: {"A": 1.0}}
    w = spark.createDataFrame([("s", t, k, v) for t, x in weights.items() for k, v in x.items()], "strategy string, rebal_date date, ticker string, weight double")
    r = spark.createDataFrame([(k, d, v) for (d, k), v in rets.items()], "ticker string, date date, log_ret double")
    p = spark.createDataFrame(periods, "rebal_date date, period_end date")
    got = {x.date: x.ret for x in backtest.run(w, r, p, flat_bps=50.0).collect()}
    want = dict(loop(weights, rets, periods, 50.0))
    assert got.keys() == want.keys()
    assert all(abs(got[d] - want[d]) < 1e-12 for d in want)


def test_returns_need_adjacent_days_and_clip(spark):
    rows = [("A", DAYS[0], 10.0, 1.0), ("A", DAYS[1], 20.0, 0.0), ("A", DAYS[3], 21.0, 2.0), ("B", DAYS[0], 1.0, 1.0), ("B", DAYS[1], 1.1, 1.0), ("B", DAYS[2], 1.2, 1.0), ("B", DAYS[3], 0.0, 1.0)]
    p = spark.createDataFrame(rows, "ticker string, date date, close double, volume double")
    got = {(r.ticker, r.date): r.log_ret for r in panel.log_returns(p).collect()}
    assert got["A", DAYS[1]] == 0.5 and ("A", DAYS[3]) not in got  # clipped; the day after a gap has none
    assert got["B", DAYS[3]] == -0.5 and abs(got["B", DAYS[2]] - math.log(1.2 / 1.1)) < 1e-15
    assert {(r.ticker, r.date) for r in panel.dollar_volume(p).where("ticker = 'A'").collect()} == {("A", DAYS[0]), ("A", DAYS[3])}


def test_universe_ignores_the_rebalance_day(spark):
    days = [date(2021, 1, 1) + timedelta(days=k) for k in range(60)]
    rows = [(t, d, 10.0 + i * 0.01, v) for t, v in (("A", 5e5), ("B", 5e4)) for i, d in enumerate(days)]
    t = days[40]
    changed = [(a, d, 1.0, 1.0) if d >= t else (a, d, c, v) for a, d, c, v in rows]
    out = []
    for r in (rows, changed):
        p = spark.createDataFrame(r, "ticker string, date date, close double, volume double")
        cal = panel.calendar(p)
        places = calendars.date_places(cal, spark.createDataFrame([(t,)], "rebal_date date"))
        adv = universe.median_adv(panel.dollar_volume(p), cal, places)
        full = universe.completeness(panel.log_returns(p), places)
        out.append(sorted(universe.investable(adv, full, adv).collect()))
    assert out[0] == out[1] and [r.ticker for r in out[0]] == ["A"]


def test_tiers_and_quarters(spark):
    adv = spark.createDataFrame([(6e8,), (5e8,), (1e8,), (5e7,), (1e7,), (0.0,), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in adv.select(costs.tier(F.col("x"))).collect()]
    assert got == ["large_cap", "large_cap", "mid_cap", "mid_cap", "small_cap", "small_cap", "small_cap", "small_cap"]
    assert calendars.quarterly_dates(spark, "2007-04-01", "2025-12-31").count() == 75
    assert calendars.quarterly_dates(spark, "2020-02-15", "2020-12-31").count() == 3


def test_metrics_of_a_short_series(spark):
    x = [0.01, -0.02, 0.03]
    r = spark.createDataFrame([("s", DAYS[k], v) for k, v in enumerate(x)], "strategy string, date date, ret double")
    m = metrics.performance(r).first()
    assert abs(m.annualized_return - np.mean(x) * 252) < 1e-12
    assert abs(m.annualized_volatility - np.std(x, ddof=1) * math.sqrt(252)) < 1e-12
    assert abs(m.max_drawdown + 0.02) < 1e-12
