"""Pair sums by blocks and Kendall's tau by inversions against plain computations."""

import itertools
import random
import resource

import numpy as np
import pytest

from ledgerline.operators import covariance, gram, rank
from pyspark.sql import functions as F


def window_rows(p=7, n=30, dates=("d1", "d2"), seed=1):
    rng = np.random.default_rng(seed)
    return [(d, f"T{k:03d}", t, float(x)) for d in dates for k in range(p) for t, x in enumerate(rng.normal(size=n)) if rng.random() < 0.8 or k == 0]


def frame(spark, rows):
    return spark.createDataFrame(rows, "rebal_date string, ticker string, date_idx int, x double")


def plain_sums(rows, same=True):
    by = {}
    for d, t, day, x in rows:
        if x is not None:
            by.setdefault((d, t), {})[day] = x
    out = {}
    for (d, a), (e, b) in itertools.product(by, by):
        if d == e and (a <= b if same else a < b):
            days = by[d, a].keys() & by[d, b].keys()
            if days:
                u, v = (np.array([by[d, t][k] for k in sorted(days)]) for t in (a, b))
                out[d, a, b] = (len(days), u @ v, u.sum(), v.sum(), u @ u, v @ v)
    return out


@pytest.mark.parametrize("block,days", [(256, 512), (2, 512), (3, 7), (1, 1)])
def test_pair_sums_equal_plain_sums_for_any_blocks_and_slices(spark, block, days):
    rows = [*window_rows(), ("d3", "ONLY", 5, 2.0), ("d3", "OTHER", 6, 1.0), ("d3", "NULL", 5, None), ("d3", "Ü", 5, -1.0)]
    for same in (True, False):
        got = {(r.rebal_date, r.a, r.b): (r.n, r.xy, r.xa, r.xb, r.xxa, r.xxb) for r in gram.pair_sums(frame(spark, rows), same=same, block=block, days=days).collect()}
        want = plain_sums(rows, same)
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_correlations_of_constants_and_few_days(spark):
    rows = [("d", "A", t, 0.1) for t in range(5)] + [("d", "B", t, float(t)) for t in range(5)] + [("d", "C", 4, 1.0)] + [("d", "D", t, 1e6 + (t % 2) * 1e-3) for t in range(5)] + [("d", "E", t, (t % 2) * 7.0) for t in range(5)]
    got = {(r.a, r.b): (r.corr, r.n) for r in covariance.realized_corr(frame(spark, rows)).collect()}
    assert got["A", "B"] == (None, 5) and got["B", "C"] == (None, 1) and abs(got["D", "E"][0] - 1) < 1e-6
    assert covariance.realized_corr(frame(spark, [])).count() == 0 and covariance.sample_cov(frame(spark, [])).count() == 0


def test_shrinkage_equals_the_matrix_form(spark):
    rows = window_rows(6, 40) + [("d2", "LATE", 39, 3.0), ("d2", "EARLY", 0, -2.0)]  # two that never meet
    got = {r.rebal_date: r.shrinkage for r in covariance.lw_shrinkage(frame(spark, rows)).collect()}
    for d in ("d1", "d2"):
        names = sorted({t for e, t, _, _ in rows if e == d})
        x = np.zeros((40, len(names)))
        for e, t, day, v in rows:
            if e == d:
                x[day, names.index(t)] = v
        c = x - x.mean(axis=0)
        n, p = c.shape
        s = c.T @ c / n
        mu = np.trace(s) / p
        far = ((s - mu * np.eye(p)) ** 2).sum() / p
        noise = sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / n**2 / p
        assert abs(got[d] - min(noise, far) / far) < 1e-9


def test_two_thousand_tickers_on_one_date(spark):
    """Two million pairs of a year's quarter, without a row for a day and a pair."""
    n, p = 60, 2000
    w = spark.range(n * p).select(F.lit("d").alias("rebal_date"), F.format_string("T%04d", F.col("id") % p).alias("ticker"), (F.col("id") / p).cast("int").alias("date_idx"), F.sin(F.col("id").cast("double") ** 1.1).alias("x"))
    df = covariance.realized_corr(w)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    x = {}
    for r in w.where("ticker IN ('T0000', 'T0777', 'T1999')").collect():
        x.setdefault(r.ticker, {})[r.date_idx] = r.x
    series = {t: np.array([v[k] for k in range(n)]) for t, v in x.items()}
    got = {(r.a, r.b): r.corr for r in df.where("a IN ('T0000', 'T0777') AND b IN ('T0777', 'T1999')").collect()}
    for a, b in (("T0000", "T0777"), ("T0000", "T1999"), ("T0777", "T1999")):
        assert abs(got[a, b] - np.corrcoef(series[a], series[b])[0, 1]) < 1e-9
    assert df.count() == p * (p - 1) // 2
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 4 << 20  # KB


def plain_tau(points):
    s = [(np.sign(a - c), np.sign(b - d)) for (a, b), (c, d) in itertools.combinations(points, 2)]
    x, y = np.array([u for u, _ in s]), np.array([v for _, v in s])
    scale = (x * x).sum() * (y * y).sum()
    return (x * y).sum() / np.sqrt(scale) if len(s) and scale else None


def test_inversions():
    rnd = random.Random(2)
    for n in (0, 1, 2, 3, 7, 8, 33, 200):
        for values in (3, 1000):
            y = [rnd.randrange(values) for _ in range(n)]
            assert rank.inversions(np.array(y, float)) == sum(a > b for a, b in itertools.combinations(y, 2))


@pytest.mark.parametrize("chunk", [10_000, 40])
def test_kendall_equals_all_pairs(spark, chunk):
    rnd = random.Random(4)
    groups = {"normal": [(rnd.gauss(0, 1), rnd.gauss(0, 1)) for _ in range(150)], "ties": [(rnd.randrange(6), rnd.randrange(4)) for _ in range(170)], "rising": [(k, k * 2) for k in range(90)], "falling": [(k, -k) for k in range(90)], "hot": [(1, rnd.random()) for _ in range(100)] + [(rnd.random() * 2, 5) for _ in range(60)], "flat": [(1, k) for k in range(50)], "one": [(1, 1)], "two": [(1, 2), (2, 1)]}
    rows = [(g, float(x), float(y)) for g, ps in groups.items() for x, y in ps] + [("normal", None, 1.0), ("normal", 1.0, None)]
    got = {r.g: r.tau for r in rank.kendall(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], chunk).collect()}
    assert got.keys() == groups.keys()
    for g, ps in groups.items():
        want = plain_tau(ps)
        assert got[g] == want if want is None else abs(got[g] - want) < 1e-12, g
