"""Sums over pairs of columns by blocked Gram matrices: long rows meet as blocks of tickers, never as (day, a, b) rows.

Tickers are dealt into blocks, days into slices; every two blocks of a slice meet in one grouped task, which makes their
products with four small matrix multiplications (values, squares and presence). A row travels once for each block, not
for each ticker it meets. Sums of several slices are added by a plain aggregate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tickers of a block and days of a slice, about: a task holds two matrices of that size, and makes one of BLOCK x BLOCK.
BLOCK, SLICE = 256, 512
_SUMS = ("n", "xy", "xa", "xb", "xxa", "xxb")


def pair_sums(window: DataFrame, shifted: bool = False, same: bool = True, block: int = BLOCK, days: int = SLICE) -> DataFrame:
    """(rebal_date, a, b, n, xy, xa, xb, xxa, xxb) of (rebal_date, ticker, date_idx, x), a <= b (or a < b): sums over the n days that both have.

    xy sums the products, xa and xxa a's values and squares, xb and xxb b's. shifted takes each ticker's least value off
    first, which a correlation doesn't feel, and which makes a constant's sums exactly zero. Pairs without a common
    day have no row; null values are absent. A (ticker, day) of a date has one row; window is read twice.
    """
    w = window.where("x IS NOT NULL").select("rebal_date", "ticker", "date_idx", "x")
    spans = w.groupBy("rebal_date").agg(F.min("date_idx").alias("first"), F.max("date_idx").alias("last"), F.approx_count_distinct("ticker", 0.02).alias("p"))
    most = spans.agg(F.max("p").alias("p"), F.max(F.col("last") - F.col("first")).alias("span")).first()
    if most.p is None:
        return w.sparkSession.createDataFrame([], f"rebal_date {dict(w.dtypes)['rebal_date']}, a string, b string, n long, {', '.join(f'{c} double' for c in _SUMS[1:])}")
    blocks, slices = -(-most.p // block), most.span // days + 1
    if shifted:
        least = w.groupBy("rebal_date", "ticker").agg(F.min("x").alias("least"))
        w = w.join(least, ["rebal_date", "ticker"]).withColumn("x", F.col("x") - F.col("least")).drop("least")
    w = w.join(F.broadcast(spans.select("rebal_date", "first")), "rebal_date")  # a row a date
    w = w.withColumns({"slice": F.floor((F.col("date_idx") - F.col("first")) / days).cast("int"), "block": F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int")}).drop("first")
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, "block").alias("lo"), F.greatest(o, "block").alias("hi")))
    w = w.withColumn("meets", F.explode(meets)).select("rebal_date", "slice", F.col("meets.lo").alias("lo"), F.col("meets.hi").alias("hi"), "block", "ticker", "date_idx", "x")
    kind = dict(w.dtypes)["rebal_date"]
    schema = f"rebal_date {kind}, a string, b string, n long, {', '.join(f'{c} double' for c in _SUMS[1:])}"

    def multiply(key, t):  # noqa: ANN001, ANN202
        return _products(key[0], t, same)

    sums = w.groupBy("rebal_date", "slice", "lo", "hi").applyInArrow(multiply, schema)
    if slices == 1:
        return sums
    return sums.groupBy("rebal_date", "a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _products(date, t, same: bool):  # noqa: ANN001, ANN202
    """The sums of all pairs of two blocks of tickers (or of one with itself), a table of rows (lo, hi, block, ticker, date_idx, x)."""
    import pyarrow as pa

    day = np.unique(t["date_idx"].to_numpy(), return_inverse=True)[1]
    names, ticker = np.unique(t["ticker"].to_numpy(zero_copy_only=False), return_inverse=True)
    of = np.zeros(len(names), np.int64)
    of[ticker] = t["block"].to_numpy()
    x = np.zeros((day.max() + 1, len(names)))
    there = np.zeros_like(x)
    x[day, ticker], there[day, ticker] = t["x"].to_numpy(), 1.0
    lo, hi = np.flatnonzero(of == of.min()), np.flatnonzero(of == of.max())
    if t["lo"][0].as_py() != t["hi"][0].as_py() and of.min() == of.max():  # the other block has no row here
        lo = lo[:0]
    left, right = x[:, lo], x[:, hi]
    m, k = there[:, lo], there[:, hi]
    made = [m.T @ k, left.T @ right, left.T @ k, m.T @ right, (left * left).T @ k, m.T @ (right * right)]
    a, b = np.broadcast_to(lo[:, None], made[0].shape), np.broadcast_to(hi[None, :], made[0].shape)
    # a pair stands once, its lesser name first; names are in order, so places are too
    keep = made[0] > 0
    if len(lo) and np.array_equal(lo, hi):
        keep &= (a <= b) if same else (a < b)
    a, b, made = a[keep], b[keep], [p[keep] for p in made]
    swap = a > b
    n, xy, xa, xb, xxa, xxb = made
    flip = lambda u, v: (np.where(swap, v, u), np.where(swap, u, v))
    (a, b), (xa, xb), (xxa, xxb) = flip(a, b), flip(xa, xb), flip(xxa, xxb)
    texts = pa.array(names.tolist(), pa.string())
    columns = [texts.take(pa.array(a)), texts.take(pa.array(b)), pa.array(np.rint(n).astype(np.int64)), *(pa.array(c) for c in (xy, xa, xb, xxa, xxb))]
    return pa.table([pa.array([date.as_py()] * len(a), date.type), *columns], names=["rebal_date", "a", "b", *_SUMS])
