"""Queries over the price panel: returns, universes, costs, backtests and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import audit, backtest, calendars, costs, metrics, panel, universe
from ledgerline.plans import tables as t
from ledgerline.plans.registry import query, rounded

TIERS = (costs.Tier("large_cap", 6_000.0, 10.0), costs.Tier("mid_cap", 4_000.0, 20.0), costs.Tier("small_cap", 0.0, 50.0))
RAW = "ln(close / before)"


@query("price_panel", t.sql(t.PX, "SELECT ticker, date, round(close, 6) AS close, round(volume, 6) AS volume FROM px"))
def price_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.prices(spark, d))


@query("trading_calendar_idx", t.sql(t.PX, t.CAL, "SELECT date, CAST(date_idx AS INT) AS date_idx FROM cal", grain="day"))
def trading_calendar_idx(spark: SparkSession, d: str) -> DataFrame:
    return panel.calendar(t.prices(spark, d, "day"))


for _name, _grain, _clip in (("log_returns_gappy", "day", None), ("log_returns", "week", None), ("log_returns_clipped", "week", 0.5)):

    @query(_name, t.sql(t.PX, t.CAL, t.RET, "SELECT ticker, date, round(log_ret, 6) AS log_ret FROM ret WHERE log_ret IS NOT NULL", grain=_grain, clip=t.CLIP if _clip else RAW))
    def log_returns(spark: SparkSession, d: str, grain: str = _grain, clip: float | None = _clip) -> DataFrame:
        return rounded(t.returns(spark, d, grain, clip).select("ticker", "date", "log_ret"))


_PERIOD = """ends AS (SELECT ticker, {end} AS date, {number} AS n, arg_max(close, date) AS close FROM px GROUP BY ALL),
l AS (SELECT ticker, date, close, lag(close) OVER w AS before, n - lag(n) OVER w AS gap FROM ends WINDOW w AS (PARTITION BY ticker ORDER BY n))"""
_LAST = "SELECT ticker, date, round(greatest(least(ln(close / before), 0.5), -0.5), 6) AS log_ret FROM l WHERE gap = 1"
_FRIDAY = "CAST(date + CAST((12 - isodow(date)) % 7 AS INT) AS DATE)"
for _name, _frequency, _end, _number in (
    ("weekly_returns", "weekly", _FRIDAY, f"CAST(({_FRIDAY} - DATE '1970-01-02') // 7 AS INT)"),
    ("monthly_returns", "monthly", "last_day(date)", "year(date) * 12 + month(date)"),
):

    @query(_name, t.sql(t.PX, _PERIOD.replace("{end}", _end).replace("{number}", _number), _LAST, grain="day"))
    def period_returns(spark: SparkSession, d: str, frequency: str = _frequency) -> DataFrame:
        return rounded(panel.log_returns(t.prices(spark, d, "day"), frequency).select("ticker", "date", "log_ret"))


@query("simple_returns", t.sql(t.PX, t.CAL, t.RET, "SELECT ticker, date, round(exp(log_ret) - 1, 6) AS ret FROM ret"))
def simple_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel.simple_returns(t.returns(spark, d)).select("ticker", "date", "ret"))


@query("dollar_volume", t.sql(t.PX, t.DV, "SELECT ticker, date, round(dv, 4) AS dv FROM dv"))
def dollar_volume(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel.dollar_volume(t.prices(spark, d)), 4)


@query("quarterly_dates", "SELECT CAST(x AS DATE) AS rebal_date FROM (SELECT unnest(generate_series(date_trunc('quarter', CAST(min(l_shipdate) AS DATE)), CAST(max(l_shipdate) AS DATE), INTERVAL 3 MONTH)) AS x, CAST(min(l_shipdate) AS DATE) AS a FROM lineitem) WHERE x >= a")
def quarterly_dates(spark: SparkSession, d: str) -> DataFrame:
    """The quarters' first days in the span that prices cover."""
    span = t.read(spark, d, "lineitem").agg(F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("b")).first()
    return calendars.quarterly_dates(spark, span.a, span.b)


@query("holding_periods", t.sql(t.PX, t.CAL, t.REBAL, "SELECT rebal_date, period_end FROM periods"))
def holding_periods(spark: SparkSession, d: str) -> DataFrame:
    return calendars.holding_periods(t.rebalances(spark), "2001-10-01")


@query("quarter_bounds", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end FROM orders")
def quarter_bounds(spark: SparkSession, d: str) -> DataFrame:
    o = t.read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return o.select("date", calendars.quarter_start(F.col("date")).alias("quarter_start"), calendars.quarter_end(F.col("date")).alias("quarter_end"))


def _adv(spark: SparkSession, d: str) -> DataFrame:
    cal, places = t.places(spark, d)
    return universe.median_adv(panel.dollar_volume(t.panel_prices(spark, d)), cal, places, t.ADV_LOOKBACK)


@query("median_adv", t.sql(t.PX, t.CAL, t.DV, t.REBAL, t.ADV, "SELECT rebal_date, ticker, round(median_adv, 4) AS median_adv FROM adv"))
def median_adv(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_adv(spark, d), 4)


@query("return_completeness", t.sql(t.PX, t.CAL, t.RET, t.REBAL, t.COMPLETE, "SELECT rebal_date, ticker, n_ret, CAST(n_days AS INT) AS n_days FROM complete", grain="day"))
def return_completeness(spark: SparkSession, d: str) -> DataFrame:
    return universe.completeness(t.returns(spark, d, "day"), t.places(spark, d, "day")[1], t.LOOKBACK).select("rebal_date", "ticker", "n_ret", F.col("n_days").cast("int").alias("n_days"))


def members(spark: SparkSession, d: str, max_firms: int | None = None, threshold: float = t.ADV_THRESHOLD) -> DataFrame:
    def make() -> DataFrame:
        complete = universe.completeness(t.returns(spark, d), t.places(spark, d)[1], t.LOOKBACK)
        everyone = t.rebalances(spark).crossJoin(F.broadcast(t.sectors(spark, d).select("ticker")))  # dates times tickers is the grid itself
        return universe.investable(_adv(spark, d), complete, everyone, least_adv=threshold, most=max_firms)

    return t.once(("members", d, max_firms, threshold), make)


@query("universe_filter", t.sql(*t.BASE, "SELECT rebal_date, ticker, round(median_adv, 4) AS median_adv FROM universe"))
def universe_filter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(members(spark, d), 4)


_TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY rebal_date ORDER BY median_adv DESC, ticker) AS rn FROM universe)"


@query("universe_top_n", t.sql(*t.BASE, _TOP, "SELECT rebal_date, ticker FROM top WHERE rn <= 10"))
def universe_top_n(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d, 10).select("rebal_date", "ticker")


@query("universe_sizes", t.sql(*t.BASE, "SELECT rebal_date, count(*) AS n FROM universe GROUP BY 1"))
def universe_sizes(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d).groupBy("rebal_date").agg(F.count("*").alias("n"))


_CHANGES = """m AS (SELECT rebal_date, ticker FROM top WHERE rn <= 10), q AS (SELECT rebal_date, row_number() OVER (ORDER BY rebal_date) AS q FROM (SELECT DISTINCT rebal_date FROM m)),
mq AS (SELECT ticker, q, lag(q) OVER w AS b, lead(q) OVER w AS a FROM m JOIN q USING (rebal_date) WINDOW w AS (PARTITION BY ticker ORDER BY q)),
changes AS (SELECT q.rebal_date, (SELECT count(*) FROM mq WHERE mq.q = q.q) AS n_members, (SELECT count(*) FROM mq WHERE mq.q = q.q AND q.q > 1 AND (b IS NULL OR b < mq.q - 1)) AS entries,
  (SELECT count(*) FROM mq WHERE mq.q = q.q - 1 AND (a IS NULL OR a > mq.q + 1)) AS exits FROM q)"""


@query("universe_entries_exits", t.sql(*t.BASE, _TOP, _CHANGES, "SELECT * FROM changes"))
def universe_entries_exits(spark: SparkSession, d: str) -> DataFrame:
    return universe.entries_exits(members(spark, d, 10))


@query("universe_churn", t.sql(*t.BASE, _TOP, _CHANGES, "SELECT round(avg(entries), 6) AS mean_entries, CAST(min(entries) AS DOUBLE) AS min_entries, CAST(max(entries) AS DOUBLE) AS max_entries, round(avg(exits), 6) AS mean_exits, CAST(min(exits) AS DOUBLE) AS min_exits, CAST(max(exits) AS DOUBLE) AS max_exits FROM changes WHERE rebal_date > (SELECT min(rebal_date) FROM changes)"))
def universe_churn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(universe.churn_summary(universe.entries_exits(members(spark, d, 10))))


@query("first_last_seen", t.sql(*t.BASE, _TOP, "SELECT ticker, count(*) AS n_quarters, min(rebal_date) AS first_seen, max(rebal_date) AS last_seen FROM top WHERE rn <= 10 GROUP BY 1"))
def first_last_seen(spark: SparkSession, d: str) -> DataFrame:
    return universe.tenure(members(spark, d, 10))


@query("last_price_date", t.sql(t.PX, "SELECT ticker, max(date) AS last_date FROM px GROUP BY 1", grain="day"))
def last_price_date(spark: SparkSession, d: str) -> DataFrame:
    return universe.last_price_dates(t.prices(spark, d, "day"))


@query("delisted", t.sql(t.PX, "SELECT ticker, max(date) AS last_date FROM px GROUP BY 1 HAVING max(date) < DATE '2001-11-04'", grain="day"))
def delisted(spark: SparkSession, d: str) -> DataFrame:
    return universe.delisted(t.prices(spark, d, "day"), "2001-11-04")


@query("liquid_screen", t.sql(t.PX, "a AS (SELECT ticker, close * volume AS x, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM px)", "SELECT ticker, round(avg(x), 4) AS adv FROM a WHERE rn <= 252 GROUP BY 1 HAVING count(*) >= 126 AND avg(x) > 0 ORDER BY avg(x) DESC, ticker LIMIT 20"))
def liquid_screen(spark: SparkSession, d: str) -> DataFrame:
    return rounded(universe.liquid_screen(t.prices(spark, d), top_n=20), 4)


_TIER = "CASE WHEN median_adv >= 6000 THEN '{0}' WHEN median_adv >= 4000 THEN '{1}' ELSE '{2}' END"


@query("tc_tiers", t.sql(t.PX, t.CAL, t.DV, t.REBAL, t.ADV, f"SELECT rebal_date, ticker, {_TIER.format('large_cap', 'mid_cap', 'small_cap')} AS tier FROM adv"))
def tc_tiers(spark: SparkSession, d: str) -> DataFrame:
    return _adv(spark, d).select("rebal_date", "ticker", costs.tier(F.col("median_adv"), "name", TIERS).alias("tier"))


_REGIME = """vr AS (SELECT p.rebal_date, r.ticker, stddev_samp(r.log_ret) AS v FROM ret r JOIN places p ON r.date_idx BETWEEN greatest(p.t_idx - 63, 1) AND p.t_idx - 1 GROUP BY ALL),
vl AS (SELECT p.rebal_date, r.ticker, stddev_samp(r.log_ret) AS v FROM ret r JOIN places p ON r.date_idx < p.t_idx GROUP BY ALL),
regime AS (SELECT p.rebal_date, CASE WHEN p.t_idx - 1 >= 126 AND l.v > 0 AND r.v IS NOT NULL THEN greatest(1.0, least(r.v / l.v, 2.0)) ELSE 1.0 END AS multiplier FROM places p
  LEFT JOIN (SELECT rebal_date, median(v) AS v FROM vr GROUP BY 1) r USING (rebal_date) LEFT JOIN (SELECT rebal_date, median(v) AS v FROM vl GROUP BY 1) l USING (rebal_date))"""


@query("vol_regime", t.sql(t.PX, t.CAL, t.RET, t.REBAL, _REGIME, "SELECT rebal_date, round(CAST(multiplier AS DOUBLE), 6) AS multiplier FROM regime"))
def vol_regime(spark: SparkSession, d: str) -> DataFrame:
    return rounded(costs.vol_regime(t.returns(spark, d), t.places(spark, d)[1]))


def rates(spark: SparkSession, d: str) -> DataFrame:
    return costs.tc_rates(_adv(spark, d), costs.vol_regime(t.returns(spark, d), t.places(spark, d)[1]), TIERS)


_RATES = f"rates AS (SELECT a.rebal_date, a.ticker, CAST({_TIER.format('10', '20', '50')} AS DOUBLE) / 10000.0 * g.multiplier AS tc_rate FROM adv a JOIN regime g USING (rebal_date))"


@query("tc_rates", t.sql(t.PX, t.CAL, t.RET, t.DV, t.REBAL, t.ADV, _REGIME, _RATES, "SELECT rebal_date, ticker, round(CAST(tc_rate AS DOUBLE), 8) AS tc_rate FROM rates"))
def tc_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rates(spark, d), 8)


@query("tc_multiplier_sweep", t.sql(t.PX, t.CAL, t.RET, t.DV, t.REBAL, t.ADV, _REGIME, _RATES, "SELECT rebal_date, ticker, CAST(f AS DOUBLE) AS factor, round(CAST(tc_rate AS DOUBLE) * CAST(f AS DOUBLE), 8) AS tc_rate FROM rates, (SELECT unnest([0.5, 1.0, 1.5, 2.0]) AS f)"))
def tc_multiplier_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(costs.multiplier_sweep(rates(spark, d)), 8).select("rebal_date", "ticker", "factor", "tc_rate")


def equal_weights(members: DataFrame, strategy: str = "equal_weight") -> DataFrame:
    return members.select(F.lit(strategy).alias("strategy"), "rebal_date", "ticker", (1.0 / F.count("*").over(Window.partitionBy("rebal_date"))).alias("weight"))


def periods(spark: SparkSession) -> DataFrame:
    return calendars.holding_periods(t.rebalances(spark), "2001-10-01")


@query("equal_weights", t.sql(*t.BASE, t.EW, "SELECT 'equal_weight' AS strategy, rebal_date, ticker, round(CAST(weight AS DOUBLE), 8) AS weight FROM weights"))
def equal_weight_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(equal_weights(members(spark, d)), 8)


def _positions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = equal_weights(members(spark, d))
    return w, t.once(("positions", d), lambda: backtest.position_days(w, t.returns(spark, d), periods(spark)))


@query("sector_weight_summary", t.sql(*t.BASE, t.EW, t.SECTOR, "sw AS (SELECT rebal_date, coalesce(sector, '_unknown') AS sector, CAST(sum(weight) AS DOUBLE) AS w FROM weights LEFT JOIN sector USING (ticker) GROUP BY ALL)", "SELECT 'equal_weight' AS strategy, rebal_date, count(*) AS n_sectors, arg_max(sector, {'w': round(w, 9), 's': sector}) AS top_sector, round(max(w), 8) AS top_weight FROM sw GROUP BY rebal_date"))
def sector_weight_summary(spark: SparkSession, d: str) -> DataFrame:
    from ledgerline.operators.portfolio import sector_weights

    return rounded(sector_weights(equal_weights(members(spark, d)), t.sectors(spark, d)), 8)


@query("weights_across_dates", t.sql(*t.BASE, t.EW, "SELECT ticker, round(avg(weight), 8) AS mean, round(stddev_pop(weight), 8) AS sd, round(min(weight), 8) AS least, round(quantile_cont(weight, 0.25), 8) AS q25, round(median(weight), 8) AS median, round(quantile_cont(weight, 0.75), 8) AS q75 FROM weights GROUP BY 1"))
def weights_across_dates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.across(equal_weights(members(spark, d)), ["ticker"], "weight"), 8)


@query("every_fourth_date", t.sql(*t.BASE, "SELECT rebal_date FROM (SELECT rebal_date, row_number() OVER (ORDER BY rebal_date) - 1 AS k FROM (SELECT DISTINCT rebal_date FROM universe)) WHERE k % 4 = 0 AND k < 16"))
def every_fourth_date(spark: SparkSession, d: str) -> DataFrame:
    """Of the dates that have members, the first and every fourth after it, four at most."""
    return calendars.every_kth(members(spark, d), 4, 4)


@query("history_buckets", t.sql(t.PX, t.CAL, t.RET, t.REBAL, "h AS (SELECT p.rebal_date, r.ticker, count(r.log_ret) AS n_ret FROM ret r JOIN places p ON r.date_idx < p.t_idx GROUP BY ALL)", "SELECT rebal_date, ticker, n_ret, CASE WHEN n_ret < 63 THEN '<63' WHEN n_ret < 126 THEN '<126' WHEN n_ret < 252 THEN '<252' ELSE '>=252' END AS bucket FROM h"))
def history_buckets(spark: SparkSession, d: str) -> DataFrame:
    h = universe.completeness(t.returns(spark, d), t.places(spark, d)[1], 1_000_000)
    return universe.history_buckets(h).select("rebal_date", "ticker", "n_ret", "bucket")


@query("tickers_with_returns", t.sql(t.PX, t.CAL, t.RET, "SELECT ticker, count(log_ret) AS n_ret FROM ret GROUP BY 1 HAVING count(log_ret) > 0"))
def tickers_with_returns(spark: SparkSession, d: str) -> DataFrame:
    return universe.with_any_return(t.returns(spark, d))


@query("benchmark_load", t.sql(t.PX, t.CAL, t.RET, "SELECT date, round(log_ret, 6) AS ret FROM ret WHERE ticker = 'Brand#11'"))
def benchmark_load(spark: SparkSession, d: str) -> DataFrame:
    from ledgerline.sources.tables import benchmark_returns

    return rounded(benchmark_returns(t.returns(spark, d), "Brand#11"))


@query("drifted_weights", t.sql(*t.EW_BACKTEST, "SELECT rebal_date, ticker, round(drifted, 8) AS drifted FROM drift"))
def drifted_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.drifted(_positions(spark, d)[1]).select("rebal_date", "ticker", "drifted"), 8)


@query("turnover_tc", t.sql(*t.EW_BACKTEST, "SELECT rebal_date, round(turnover, 8) AS turnover, round(CAST(tc AS DOUBLE), 8) AS tc FROM costs"))
def turnover_tc(spark: SparkSession, d: str) -> DataFrame:
    w, p = _positions(spark, d)
    return rounded(backtest.turnover_costs(w, backtest.drifted(p)).select("rebal_date", "turnover", "tc"), 8)


_TIERED = """rt AS (SELECT coalesce(a.rebal_date, p.rebal_date) AS rebal_date, coalesce(a.ticker, p.ticker) AS ticker, abs(coalesce(a.weight, 0) - coalesce(p.drifted, 0)) AS m
  FROM (SELECT w.* FROM weights w JOIN live USING (rebal_date)) a FULL JOIN prev p ON a.rebal_date = p.rebal_date AND a.ticker = p.ticker),
tiered AS (SELECT l.rebal_date, CASE WHEN any_value(l.before) IS NULL THEN 0.001 ELSE sum(rt.m * coalesce(r.tc_rate, 0.001)) END AS tc FROM live l JOIN rt USING (rebal_date) LEFT JOIN rates r ON r.rebal_date = rt.rebal_date AND r.ticker = rt.ticker GROUP BY l.rebal_date)"""


@query("turnover_tc_tiered", t.sql(*t.EW_BACKTEST, _REGIME, _RATES, _TIERED, "SELECT rebal_date, round(CAST(tc AS DOUBLE), 8) AS tc FROM tiered"))
def turnover_tc_tiered(spark: SparkSession, d: str) -> DataFrame:
    w, p = _positions(spark, d)
    return rounded(backtest.turnover_costs(w, backtest.drifted(p), rates(spark, d)).select("rebal_date", "tc"), 8)


def ew_returns(spark: SparkSession, d: str) -> DataFrame:
    return t.once(("ew", d), lambda: backtest.run(equal_weights(members(spark, d)), t.returns(spark, d), periods(spark)))


@query("ew_backtest_returns", t.sql(*t.EW_BACKTEST, "SELECT rebal_date, date, round(CAST(ret AS DOUBLE), 8) AS ret FROM bt"))
def ew_backtest_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ew_returns(spark, d).select("rebal_date", "date", "ret"), 8)


_TARGETS = """tt AS (SELECT rebal_date, lag(rebal_date) OVER (ORDER BY rebal_date) AS before FROM (SELECT DISTINCT rebal_date FROM {w})),
tn AS (SELECT w.rebal_date, w.ticker, w.weight FROM {w} w JOIN tt USING (rebal_date) WHERE tt.before IS NOT NULL), tp AS (SELECT tt.rebal_date, w.ticker, w.weight FROM tt JOIN {w} w ON w.rebal_date = tt.before),
tm AS (SELECT coalesce(a.rebal_date, b.rebal_date) AS rebal_date, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS x FROM tn a FULL JOIN tp b ON a.rebal_date = b.rebal_date AND a.ticker = b.ticker GROUP BY 1)"""


@query("avg_turnover", t.sql(*t.BASE, _TOP, "tw AS (SELECT rebal_date, ticker, 1.0 / count(*) OVER (PARTITION BY rebal_date) AS weight FROM top WHERE rn <= 10)", _TARGETS.replace("{w}", "tw"), "SELECT 'top10' AS strategy, round(avg(x), 8) AS avg_turnover FROM tm"))
def avg_turnover(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.average_turnover(equal_weights(members(spark, d, 10), "top10")), 8)


_CUM = """cum AS (SELECT date, ret, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cumulative FROM bt),
mx AS (SELECT *, max(cumulative) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS running_max FROM cum), dd AS (SELECT *, (cumulative - running_max) / running_max AS drawdown FROM mx)"""


@query("drawdown_series", t.sql(*t.EW_BACKTEST, _CUM, "SELECT date, round(cumulative, 6) AS cumulative, round(running_max, 6) AS running_max, round(drawdown, 6) AS drawdown FROM dd"))
def drawdown_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.drawdowns(ew_returns(spark, d)).drop("strategy"))


_PERFORMANCE = """perf AS (SELECT avg(ret) * 252 AS annualized_return, stddev_samp(ret) * sqrt(252) AS annualized_volatility, sqrt(avg(least(ret, 0) ** 2)) * sqrt(252) AS downside, min(drawdown) AS max_drawdown, count(*) AS n_observations FROM dd)"""


@query("performance_metrics", t.sql(*t.EW_BACKTEST, _CUM, _PERFORMANCE, """SELECT 'equal_weight' AS strategy, round(annualized_return, 6) AS annualized_return, round(annualized_volatility, 6) AS annualized_volatility,
  round(annualized_return / annualized_volatility, 6) AS sharpe_ratio, round(annualized_return / downside, 6) AS sortino_ratio, round(max_drawdown, 6) AS max_drawdown, round(annualized_return / abs(max_drawdown), 6) AS calmar_ratio, n_observations FROM perf"""))
def performance_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.performance(ew_returns(spark, d)))


_MARKET = "mkt AS (SELECT date, avg(exp(log_ret) - 1) AS b FROM ret GROUP BY 1)"


def market(spark: SparkSession, d: str) -> DataFrame:
    """(date, ret): the mean simple return of all tickers."""
    return panel.simple_returns(t.returns(spark, d)).groupBy("date").agg(F.avg("ret").alias("ret"))


@query("benchmark_metrics", t.sql(*t.EW_BACKTEST, _MARKET, """SELECT 'equal_weight' AS strategy, round(avg(ret - b) * 252 / (stddev_samp(ret - b) * sqrt(252)), 6) AS information_ratio, round(stddev_samp(ret - b) * sqrt(252), 6) AS tracking_error,
  round(regr_intercept(ret, b) * 252, 6) AS capm_alpha, round(regr_slope(ret, b), 6) AS capm_beta, count(*) AS n_common FROM bt JOIN mkt USING (date)"""))
def benchmark_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.against_benchmark(ew_returns(spark, d), market(spark, d)))


_HAC = """j AS (SELECT row_number() OVER (ORDER BY date) AS i, ret AS y, b FROM bt JOIN mkt USING (date)), f AS (SELECT regr_intercept(y, b) AS a, regr_slope(y, b) AS s, count(*) AS n, sum(b) AS sb, sum(b * b) AS sbb FROM j),
u AS (SELECT i, y - a - s * b AS g0, (y - a - s * b) * b AS g1 FROM j, f), lagged_u AS (SELECT k, sum(x.g0 * z.g0) AS s00, sum(x.g0 * z.g1 + x.g1 * z.g0) / 2 AS s01, sum(x.g1 * z.g1) AS s11 FROM (SELECT unnest(range(0, 11)) AS k) JOIN u x ON true JOIN u z ON z.i = x.i - k GROUP BY k),
m AS (SELECT sum(c * s00) AS m00, sum(c * s01) AS m01, sum(c * s11) AS m11 FROM (SELECT *, CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / 11.0) END AS c FROM lagged_u)),
v AS (SELECT a, s, n, (sbb * sbb * m00 - 2 * sbb * sb * m01 + sb * sb * m11) / (n * sbb - sb * sb) ** 2 AS va FROM f, m)"""


@query("capm_hac", t.sql(*t.EW_BACKTEST, _MARKET, _HAC, "SELECT 'equal_weight' AS strategy, round(a * 252, 6) AS capm_alpha, round(a / sqrt(va), 5) AS capm_alpha_t, round(s, 6) AS capm_beta, n FROM v"))
def capm_hac(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.capm_hac(ew_returns(spark, d), market(spark, d)).drop("capm_alpha_p").withColumn("capm_alpha_t", F.round("capm_alpha_t", 5)))


@query("capm_beta", t.sql(t.PX, t.CAL, t.RET, _MARKET, "SELECT ticker, round(regr_slope(exp(log_ret) - 1, b), 6) AS beta, count(*) AS n FROM ret JOIN mkt USING (date) GROUP BY 1"))
def capm_beta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.capm_beta(panel.simple_returns(t.returns(spark, d)), market(spark, d)))


@query("higher_moments", t.sql(*t.EW_BACKTEST, """z AS (SELECT ret, avg(ret) OVER () AS m, stddev_pop(ret) OVER () AS s FROM bt),
mo AS (SELECT avg(((ret - m) / s) ** 3) AS sk, avg(((ret - m) / s) ** 4) - 3 AS ku, count(*) AS n, quantile_cont(ret, 0.05) AS v5, quantile_cont(ret, 0.01) AS v1 FROM z)""", """SELECT 'equal_weight' AS strategy, round(sk, 6) AS skewness, round(ku, 6) AS excess_kurtosis,
  round(n / 6.0 * (sk ** 2 + ku ** 2 / 4), 5) AS jarque_bera, round(v5, 6) AS var_5, round((SELECT avg(ret) FROM bt WHERE ret <= v5), 6) AS cvar_5, round(v1, 6) AS var_1, round((SELECT avg(ret) FROM bt WHERE ret <= v1), 6) AS cvar_1 FROM mo"""))
def higher_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.moments(ew_returns(spark, d)).drop("jb_pvalue").withColumn("jarque_bera", F.round("jarque_bera", 5)))


_RAW = (t.PX, t.CAL, t.RET)


@query("return_distribution", t.sql(*_RAW, """s AS (SELECT count(*) AS n, avg(log_ret) AS m, stddev_pop(log_ret) AS sd FROM ret), z AS (SELECT log_ret, (log_ret - m) / sd AS z, n FROM ret, s), k AS (SELECT avg(z ** 3) AS g1, avg(z ** 4) - 3 AS g2 FROM z)""", """SELECT count(*) AS n_observations, count(DISTINCT ticker) AS n_tickers, count(DISTINCT date) AS n_days, round(avg(log_ret), 8) AS mean, round(stddev_pop(log_ret), 6) AS std, round(min(log_ret), 6) AS min, round(max(log_ret), 6) AS max,
  round(quantile_cont(log_ret, 0.001), 6) AS p0_1, round(quantile_cont(log_ret, 0.01), 6) AS p1, round(quantile_cont(log_ret, 0.05), 6) AS p5, round(quantile_cont(log_ret, 0.25), 6) AS p25, round(quantile_cont(log_ret, 0.5), 6) AS p50,
  round(quantile_cont(log_ret, 0.75), 6) AS p75, round(quantile_cont(log_ret, 0.95), 6) AS p95, round(quantile_cont(log_ret, 0.99), 6) AS p99, round(quantile_cont(log_ret, 0.999), 6) AS p99_9,
  round((SELECT g1 FROM k) * sqrt(count(*) * (count(*) - 1.0)) / (count(*) - 2), 4) AS skewness, round((count(*) - 1.0) / ((count(*) - 2.0) * (count(*) - 3.0)) * ((count(*) + 1) * (SELECT g2 FROM k) + 6), 4) AS kurtosis,
  CAST(count_if(abs(log_ret) > 0.1) AS BIGINT) AS gt_0_10, CAST(count_if(abs(log_ret) > 0.2) AS BIGINT) AS gt_0_20, CAST(count_if(abs(log_ret) > 0.3) AS BIGINT) AS gt_0_30, CAST(count_if(abs(log_ret) > 0.5) AS BIGINT) AS gt_0_50, CAST(count_if(abs(log_ret) > 0.75) AS BIGINT) AS gt_0_75, CAST(count_if(abs(log_ret) > 1.0) AS BIGINT) AS gt_1_00 FROM ret""", grain="day", clip=RAW))
def return_distribution(spark: SparkSession, d: str) -> DataFrame:
    return audit.distribution(t.returns(spark, d, "day", None))


@query("clipping_impact", t.sql(*_RAW, """SELECT CAST(count_if(abs(log_ret) > 0.3) AS BIGINT) AS n_clipped, round(100.0 * count_if(abs(log_ret) > 0.3) / count(*), 6) AS pct_clipped, count(DISTINCT CASE WHEN abs(log_ret) > 0.3 THEN ticker END) AS n_tickers_affected,
  round(avg(log_ret), 8) AS mean_before, round(avg(greatest(least(log_ret, 0.3), -0.3)), 8) AS mean_after, round(stddev_pop(log_ret), 6) AS std_before, round(stddev_pop(greatest(least(log_ret, 0.3), -0.3)), 6) AS std_after FROM ret""", grain="day", clip=RAW))
def clipping_impact(spark: SparkSession, d: str) -> DataFrame:
    return audit.clipping_impact(t.returns(spark, d, "day", None), 0.3)


@query("consecutive_extremes", t.sql(*_RAW, "l2 AS (SELECT ticker, date AS date2, log_ret AS r2, lag(date) OVER w AS date1, lag(log_ret) OVER w AS r1 FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date))", "SELECT ticker, date1, date2, round(r1, 4) AS return1, round(r2, 4) AS return2 FROM l2 WHERE abs(r1) > 0.3 AND abs(r2) > 0.3", grain="day", clip=RAW))
def consecutive_extremes(spark: SparkSession, d: str) -> DataFrame:
    return audit.consecutive_extremes(t.returns(spark, d, "day", None), 0.3)


_EVENTS = "ev AS (SELECT DISTINCT p_brand AS ticker, CAST(DATE '1998-01-03' + CAST(CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) * 11 AS INT) AS DATE) AS event_date FROM part)"


@query("split_asof_check", t.sql(*_RAW, _EVENTS, "m AS (SELECT e.ticker, e.event_date, min(r.date) AS actual_date FROM ev e LEFT JOIN ret r ON r.ticker = e.ticker AND r.date BETWEEN e.event_date AND e.event_date + INTERVAL 5 DAY GROUP BY ALL)", """SELECT m.ticker, m.event_date, m.actual_date, round(r.log_ret, 6) AS return_on_date,
  CASE WHEN r.log_ret IS NULL THEN 'DATE_NOT_FOUND' WHEN abs(r.log_ret) < 0.15 THEN 'PASS' ELSE 'FAIL_SPIKE' END AS status FROM m LEFT JOIN ret r ON r.ticker = m.ticker AND r.date = m.actual_date""", grain="day", clip=RAW))
def split_asof_check(spark: SparkSession, d: str) -> DataFrame:
    e = t.sectors(spark, d).select("ticker", F.expr("date_add(DATE'1998-01-03', CAST(regexp_extract(ticker, '(\\\\d+)', 1) AS INT) * 11)").alias("event_date"))
    return audit.event_check(e, t.returns(spark, d, "day", None))


@query(
    "split_verdict",
    t.sql(*_RAW, _EVENTS, "m AS (SELECT e.ticker, e.event_date, min(r.date) AS actual_date FROM ev e LEFT JOIN ret r ON r.ticker = e.ticker AND r.date BETWEEN e.event_date AND e.event_date + INTERVAL 5 DAY GROUP BY ALL)", f"s AS (SELECT CASE WHEN r.log_ret IS NULL THEN 'none' WHEN abs(r.log_ret) < 0.15 THEN 'PASS' ELSE 'FAIL_SPIKE' END AS status FROM m LEFT JOIN ret r ON r.ticker = m.ticker AND r.date = m.actual_date)", f"SELECT count(*) + {len(audit.KNOWN_SPLITS)} AS splits_checked, count_if(status <> 'none') AS data_available, count_if(status = 'PASS') AS passed, count_if(status = 'FAIL_SPIKE') AS failed, CASE WHEN count_if(status <> 'none') > 0 AND count_if(status = 'FAIL_SPIKE') = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s", grain="day", clip=RAW),
)
def split_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The audit of the known splits (which the tables have no prices of) and of a made-up one for every ticker."""
    e = t.sectors(spark, d).select("ticker", F.expr("date_add(DATE'1998-01-03', CAST(regexp_extract(ticker, '(\\\\d+)', 1) AS INT) * 11)").alias("event_date"), F.lit("1:1").alias("ratio"))
    return audit.split_verdict(audit.split_audit(e.unionByName(audit.known_splits(spark)), t.returns(spark, d, "day", None)))


@query(
    "presence_audit",
    t.sql(*t.BASE, f"n AS (SELECT unnest([{', '.join(repr(x) for x in audit.CRISIS_TICKERS)}]) AS ticker UNION SELECT DISTINCT p_brand FROM part)", "l AS (SELECT ticker, max(date) AS last_price_date FROM px WHERE close IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT 'Brand#' || (1 + vec_id % 25) AS ticker FROM embeddings), m AS (SELECT ticker, min(rebal_date) AS first_in_universe, max(rebal_date) AS last_in_universe, count(*) AS quarters_in_universe FROM universe GROUP BY 1)", "SELECT n.ticker, last_price_date IS NOT NULL AS has_prices, e.ticker IS NOT NULL AS has_embeddings, first_in_universe IS NOT NULL AS ever_in_universe, last_price_date, first_in_universe, last_in_universe, coalesce(quarters_in_universe, 0) AS quarters_in_universe FROM n LEFT JOIN l USING (ticker) LEFT JOIN e ON e.ticker = n.ticker LEFT JOIN m ON m.ticker = n.ticker"),
)
def presence_audit(spark: SparkSession, d: str) -> DataFrame:
    """Who of the crisis and of all brands has prices, embeddings and a place in the universe."""
    names = t.sectors(spark, d).select("ticker").unionByName(spark.createDataFrame([(x,) for x in audit.CRISIS_TICKERS], "ticker string"))
    embedded = t.read(spark, d, "embeddings").select(F.concat(F.lit("Brand#"), (1 + F.col("vec_id") % 25).cast("string")).alias("ticker"))
    return audit.presence(names, t.panel_prices(spark, d), embedded, members(spark, d))


@query("strategy_compare", t.sql(*t.EW_BACKTEST, _CUM, _PERFORMANCE, _TARGETS.replace("{w}", "weights"), "SELECT 'equal_weight' AS strategy, round(annualized_return / annualized_volatility, 6) AS sharpe_ratio, round(max_drawdown, 6) AS max_drawdown, round((SELECT avg(x) FROM tm), 6) AS avg_turnover FROM perf"))
def strategy_compare(spark: SparkSession, d: str) -> DataFrame:
    w = equal_weights(members(spark, d))
    p = metrics.performance(ew_returns(spark, d))
    return rounded(p.join(backtest.average_turnover(w), "strategy").select("strategy", "sharpe_ratio", "max_drawdown", "avg_turnover"))


@query("stream_dedup_tumbling", "SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(DISTINCT user_id) AS n FROM events GROUP BY ALL")
def stream_dedup_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """First events of each (user, type, day) counted per type and day, by an availableNow stream over the file."""
    from ledgerline.streaming import news

    schema = t.read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    day = F.date_trunc("day", "ts")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    first = stream.withColumn("key", F.concat_ws("|", "user_id", "event_type", day.cast("string")))
    counts = news.deduplicated(first, "key").groupBy("event_type", day.cast("date").alias("day")).agg(F.count("*").alias("n"))
    return news.run_once(counts)
