"""The research entities as views over the driver's tables.

ticker = part brand, date = the week (or other grain) of shipping, close = extended price per unit, volume = units;
sector = first digit of the brand's number, unknown for brands that end in 5; documents' tickers are their sources.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import calendars, panel
from ledgerline.session import cut

START, END = "1997-01-01", "2001-07-01"
ADV_THRESHOLD, ADV_LOOKBACK, LOOKBACK = 1_000.0, 21, 104


_SHARED: ContextVar[dict | None] = ContextVar("shared", default=None)


@contextmanager
def sharing() -> Iterator[None]:
    """Within it, what once() makes is made once: the steps of one query read it from the shared folder, not from the tables again."""
    token = _SHARED.set({})
    try:
        yield
    finally:
        _SHARED.reset(token)


def once(key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    known = _SHARED.get()
    if known is None:
        return make()
    if key not in known:
        known[key] = cut(make())
    # new names of the same columns, so that two uses can meet in one join
    return known[key].select(*[F.col(c).alias(c) for c in known[key].columns])


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def prices(spark: SparkSession, d: str, grain: str = "week") -> DataFrame:
    """(ticker, date, close, volume)."""
    part = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    line = read(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", F.date_trunc(grain, "l_shipdate").cast("date").alias("date"))
    # partial sums by part travel, not lines; the join then meets a row for each part and day
    by_part = line.groupBy("l_partkey", "date").agg(F.sum("l_extendedprice").alias("x"), F.sum("l_quantity").alias("q"))
    p = by_part.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("ticker", "date")
    return p.agg((F.sum("x") / F.sum("q")).alias("close"), F.sum("q").alias("volume"))


def returns(spark: SparkSession, d: str, grain: str = "week", clip: float | None = 0.5) -> DataFrame:
    return once(("returns", d, grain, clip), lambda: panel.log_returns(panel_prices(spark, d, grain), clip_bound=clip))


def panel_prices(spark: SparkSession, d: str, grain: str = "week") -> DataFrame:
    """prices() for queries that come back to it: the tables are scanned once."""
    return once(("prices", d, grain), lambda: prices(spark, d, grain))


def sectors(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, sector); sector is null where unknown."""
    t = read(spark, d, "part").select(F.col("p_brand").alias("ticker")).distinct()
    number = F.regexp_extract("ticker", r"(\d+)", 1)
    return t.select("ticker", F.when(~number.endswith("5"), F.substring(number, 1, 1)).alias("sector"))


def rebalances(spark: SparkSession) -> DataFrame:
    return calendars.quarterly_dates(spark, START, END)


def places(spark: SparkSession, d: str, grain: str = "week") -> tuple[DataFrame, DataFrame]:
    """(calendar, places of the rebalance dates in it)."""
    cal = once(("calendar", d, grain), lambda: panel.calendar(panel_prices(spark, d, grain)))
    return cal, once(("places", d, grain), lambda: calendars.date_places(cal, rebalances(spark)))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, doc_date, doc_id, embedding): label as ticker, vectors scaled so that norms differ."""
    e = read(spark, d, "embeddings")
    scale = (1 + F.col("vec_id") % 3).cast("double")
    return e.select(F.concat(F.lit("T"), F.col("label").cast("string")).alias("ticker"), F.expr("date_add(DATE'2020-01-01', CAST(vec_id * 7 % 1800 AS INT))").alias("doc_date"), F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double") * scale).alias("embedding"))


def as_of_dates(spark: SparkSession) -> DataFrame:
    return calendars.quarterly_dates(spark, "2020-04-01", "2025-01-01").withColumnRenamed("rebal_date", "as_of")


def filings(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, doc_id, year, doc_date, text)."""
    x = read(spark, d, "documents")
    return x.select(F.col("source").alias("ticker"), "doc_id", (F.lit(2010) + F.col("doc_id") % 10).cast("int").alias("year"), F.expr("make_date(CAST(2010 + doc_id % 10 AS INT), CAST(1 + doc_id % 12 AS INT), 1)").alias("doc_date"), "text")


#: The same entities for the SQL side, as WITH entries.
PX = """px AS (SELECT p.p_brand AS ticker, CAST(date_trunc('{grain}', l.l_shipdate) AS DATE) AS date,
  sum(l.l_extendedprice) / sum(l.l_quantity) AS close, sum(l.l_quantity) AS volume
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY ALL)"""
CAL = "cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS date_idx FROM (SELECT DISTINCT date FROM px))"
RET = """lagged AS (SELECT ticker, date, date_idx, close, lag(close) OVER w AS before, date_idx - lag(date_idx) OVER w AS gap
  FROM px JOIN cal USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY date_idx)),
ret AS (SELECT ticker, date, date_idx, {clip} AS log_ret FROM lagged WHERE gap = 1)"""
CLIP = "greatest(least(ln(close / before), 0.5), -0.5)"
DV = "dv AS (SELECT ticker, date, close * nullif(volume, 0) AS dv FROM px WHERE nullif(volume, 0) IS NOT NULL)"
REBAL = f"""rebal AS (SELECT CAST(d AS DATE) AS rebal_date FROM (SELECT unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 3 MONTH)) AS d)),
places AS (SELECT rebal_date, count(c.date) AS t_idx FROM rebal r LEFT JOIN cal c ON c.date < r.rebal_date GROUP BY rebal_date),
periods AS (SELECT rebal_date, coalesce(lead(rebal_date) OVER (ORDER BY rebal_date), DATE '2001-10-01') AS period_end FROM rebal)"""
ADV = f"""adv AS (SELECT p.rebal_date, d.ticker, median(d.dv) AS median_adv FROM dv d JOIN cal c USING (date) JOIN places p ON c.date_idx BETWEEN p.t_idx - {ADV_LOOKBACK} AND p.t_idx - 1 GROUP BY ALL)"""
COMPLETE = f"""complete AS (SELECT p.rebal_date, r.ticker, count(r.log_ret) AS n_ret, any_value(greatest(0, least({LOOKBACK}, p.t_idx - 1))) AS n_days
  FROM ret r JOIN places p ON r.date_idx BETWEEN greatest(p.t_idx - {LOOKBACK}, 1) AND p.t_idx - 1 GROUP BY ALL)"""
UNIVERSE = f"""universe AS (SELECT a.rebal_date, a.ticker, a.median_adv FROM adv a JOIN complete c USING (rebal_date, ticker)
  WHERE a.median_adv >= {ADV_THRESHOLD} AND c.n_ret >= floor(c.n_days * 0.8))"""
SECTOR = "sector AS (SELECT DISTINCT p_brand AS ticker, CASE WHEN NOT ends_with(regexp_extract(p_brand, '(\\d+)', 1), '5') THEN substr(regexp_extract(p_brand, '(\\d+)', 1), 1, 1) END AS sector FROM part)"
EMB = """emb AS (SELECT 'T' || CAST(label AS VARCHAR) AS ticker, CAST(DATE '2020-01-01' + CAST(vec_id * 7 % 1800 AS INT) AS DATE) AS doc_date, vec_id AS doc_id,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + vec_id % 3)) AS embedding FROM embeddings)"""
ASOF = "asofd AS (SELECT CAST(d AS DATE) AS as_of FROM (SELECT unnest(generate_series(DATE '2020-04-01', DATE '2025-01-01', INTERVAL 3 MONTH)) AS d))"
FILINGS = """filings AS (SELECT source AS ticker, doc_id, CAST(2010 + doc_id % 10 AS INT) AS year, make_date(2010 + doc_id % 10, 1 + doc_id % 12, 1) AS doc_date, text FROM documents)"""
#: Equal weights of the universe's members, and the closed form of their backtest.
EW = "weights AS (SELECT rebal_date, ticker, 1.0 / count(*) OVER (PARTITION BY rebal_date) AS weight FROM universe)"
BACKTEST = """days AS (SELECT DISTINCT p.rebal_date, r.date FROM ret r JOIN periods p ON r.date >= p.rebal_date AND r.date < p.period_end),
pos AS (SELECT w.rebal_date, d.date, w.ticker, w.weight, coalesce(exp(r.log_ret) - 1, 0) AS x FROM weights w JOIN days d USING (rebal_date) LEFT JOIN ret r ON r.ticker = w.ticker AND r.date = d.date),
grown AS (SELECT *, product(1 + x) OVER (PARTITION BY rebal_date, ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM pos),
held AS (SELECT *, weight * coalesce(lag(g) OVER (PARTITION BY rebal_date, ticker ORDER BY date), 1) AS held, weight * g AS after_ FROM grown),
lastday AS (SELECT rebal_date, ticker, arg_max(after_, date) AS after_ FROM held GROUP BY ALL),
drift AS (SELECT rebal_date, ticker, after_ / sum(after_) OVER (PARTITION BY rebal_date) AS drifted FROM lastday),
live AS (SELECT rebal_date, lag(rebal_date) OVER (ORDER BY rebal_date) AS before FROM (SELECT DISTINCT rebal_date FROM drift)),
prev AS (SELECT l.rebal_date, d.ticker, d.drifted FROM live l JOIN drift d ON d.rebal_date = l.before),
moved AS (SELECT coalesce(t.rebal_date, p.rebal_date) AS rebal_date, sum(abs(coalesce(t.weight, 0) - coalesce(p.drifted, 0))) AS turnover
  FROM (SELECT w.* FROM weights w JOIN live USING (rebal_date)) t FULL JOIN prev p ON t.rebal_date = p.rebal_date AND t.ticker = p.ticker GROUP BY 1),
costs AS (SELECT l.rebal_date, CASE WHEN l.before IS NOT NULL THEN m.turnover END AS turnover, CASE WHEN l.before IS NULL THEN 0.001 ELSE m.turnover * 0.001 END AS tc FROM live l JOIN moved m USING (rebal_date)),
sums AS (SELECT rebal_date, date, sum(held * x) AS gain, sum(held) AS value, row_number() OVER (PARTITION BY rebal_date ORDER BY date) AS rn FROM held GROUP BY rebal_date, date),
bt AS (SELECT s.rebal_date, s.date, CASE WHEN s.rn = 1 THEN s.gain - c.tc ELSE s.gain / s.value END AS ret FROM sums s JOIN costs c USING (rebal_date))"""


def sql(*parts: str, grain: str = "week", clip: str = CLIP) -> str:
    """WITH parts[:-1], then parts[-1]."""
    fill = lambda p: p.replace("{grain}", grain).replace("{clip}", clip)
    return "WITH " + ",\n".join(map(fill, parts[:-1])) + "\n" + fill(parts[-1])


BASE = (PX, CAL, RET, DV, REBAL, ADV, COMPLETE, UNIVERSE)
EW_BACKTEST = (*BASE, EW, BACKTEST)
