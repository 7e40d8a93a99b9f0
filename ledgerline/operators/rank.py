"""Rank statistics and small regressions per group, by windows and moments."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import cut


def average_rank(c: str, by: list[str]) -> Column:
    """Rank with the mean of the places for ties."""
    return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0


def spearman(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by, rho, n)."""
    r = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, average_rank(x, by).alias("rx"), average_rank(y, by).alias("ry"))
    return r.groupBy(*by).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


#: Points of a group that one task counts the inversions of; larger groups are counted in chunks of about so many.
CHUNK = 200_000


def inversions(y: np.ndarray) -> int:
    """Pairs that stand in descending order, by merging sorted runs of twice the length each time (all runs of a round at once)."""
    n = len(y)
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    found, width = 0, 1
    while width < n:
        run = np.arange(n) // (2 * width)
        keyed = run * np.int64(n) + rank  # each pair of runs has values of its own
        right = np.arange(n) % (2 * width) >= width
        # of the sorted left runs, how many up to a run's end are greater than each of its right values
        left = keyed[~right]
        upto = np.searchsorted(left, (run[right] + 1) * np.int64(n), "left")
        found += int((upto - np.searchsorted(left, keyed[right], "right")).sum())
        rank = np.sort(keyed, kind="stable") - run * np.int64(n)
        width *= 2
    return found


def _discordant(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs with x in one order and y in the other; ties in either don't count."""
    return inversions(y[np.lexsort((y, x))])


def _ties(points: DataFrame, by: list[str], *of: str) -> DataFrame:
    """(by, pairs that are alike in of)."""
    same = points.groupBy(*by, *of).agg(F.count("*").alias("_c"))
    return same.groupBy(*by).agg(F.sum(F.col("_c") * (F.col("_c") - 1) / 2).alias(f"_{''.join(of)}"))


def _counted(points: DataFrame, by: list[str], *chunk: str) -> DataFrame:
    """(by, _d): discordant pairs within each chunk, a task for each, added up."""
    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "_d double"])

    def count(key, t):  # noqa: ANN001, ANN202
        import pyarrow as pa

        d = _discordant(t["x"].to_numpy(), t["y"].to_numpy())
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key[: len(by)]), pa.array([float(d)])], names=[*by, "_d"])

    return points.groupBy(*by, *chunk).applyInArrow(count, schema).groupBy(*by).agg(F.sum("_d").alias("_d"))


def kendall(points: DataFrame, by: list[str], chunk: int = CHUNK) -> DataFrame:
    """(by, tau): tau-b over all pairs of a group's points (x, y), by counting inversions in n log n steps; null if x or y has one value.

    Groups of up to chunk points are counted in a task each. Larger ones are cut into ranges of x and ranges of y of about
    that size: discordant pairs within a range of x are counted there; of those across, the ones in different ranges
    of y follow from the counts of points in the cells, and the ones in one range of y are those found in it less
    those found in its cells. Points with a null are left out.
    """
    p = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    sizes = p.groupBy(*by).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= chunk:
        parts = [(1, _counted(p, by))]
    else:
        k = -(-most // chunk)
        places = F.array(*[F.lit(i / k) for i in range(1, k)])
        edges = p.groupBy(*by).agg(F.percentile_approx("x", places, 10 * k).alias("_ex"), F.percentile_approx("y", places, 10 * k).alias("_ey"))
        over = lambda c, e: F.size(F.filter(F.array_distinct(e), lambda v: v < c))
        p = cut(p.join(F.broadcast(edges), by).select(*by, "x", "y", over(F.col("x"), F.col("_ex")).alias("_i"), over(F.col("y"), F.col("_ey")).alias("_j")))
        parts = [(1, _counted(p, by, "_i")), (1, _counted(p, by, "_j")), (-1, _counted(p, by, "_i", "_j")), (1, _across(p, by, k))]
    d = reduce(DataFrame.unionByName, [part.select(*by, (sign * F.col("_d")).alias("_d")) for sign, part in parts]).groupBy(*by).agg(F.sum("_d").alias("_d"))
    for more in (_ties(p, by, "x"), _ties(p, by, "y"), _ties(p, by, "x", "y"), d):
        sizes = sizes.join(more, by)
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    scale = (pairs - F.col("_x")) * (pairs - F.col("_y"))
    return sizes.select(*by, F.when(scale > 0, (pairs - F.col("_x") - F.col("_y") + F.col("_xy") - 2 * F.col("_d")) / F.sqrt(scale)).alias("tau"))


def _across(p: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, _d): pairs whose cells lie in descending order of both ranges, from the cells' counts on the whole k x k grid."""
    cells = p.groupBy(*by, "_i", "_j").agg(F.count("*").alias("_c"))
    grid = cells.select(*by).distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    full = grid.join(cells, [*by, "_i", "_j"], "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    above = F.coalesce(F.sum("_c").over(Window.partitionBy(*by, "_i").orderBy(F.col("_j").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce(F.sum("_above").over(Window.partitionBy(*by, "_j").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = full.withColumn("_above", above).withColumn("_before", before)
    return full.groupBy(*by).agg(F.sum((F.col("_c") * F.col("_before")).cast("double")).alias("_d"))


def quantile_bins(df: DataFrame, by: list[str], x: str, n: int) -> DataFrame:
    """df with bin: right-closed quantile bins numbered from 0; equal edges merge."""
    e = df.groupBy(*by).agg(F.array_distinct(F.percentile(x, F.array(*[F.lit(k / n) for k in range(n + 1)]))).alias("_edges"))
    below = F.size(F.filter("_edges", lambda v: v < F.col(x)))
    return df.join(F.broadcast(e), by).withColumn("bin", F.greatest(below - 1, F.lit(0)).cast("int")).drop("_edges")


def two_regressor_r2(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, r2_first, r2_second, r2_both) of y on x1, on x2 and on both."""
    a = df.groupBy(*by).agg(F.corr("y", "x1").alias("c1"), F.corr("y", "x2").alias("c2"), F.corr("x1", "x2").alias("c12"))
    both = (F.col("c1") ** 2 + F.col("c2") ** 2 - 2 * F.col("c1") * F.col("c2") * F.col("c12")) / (1 - F.col("c12") ** 2)
    return a.select(*by, (F.col("c1") ** 2).alias("r2_first"), (F.col("c2") ** 2).alias("r2_second"), both.alias("r2_both"))


def benjamini_hochberg(tests: DataFrame, by: list[str], p: str = "p_value") -> DataFrame:
    """tests with q_value: false-discovery adjusted p-values within each group."""
    up = Window.partitionBy(*by).orderBy(p)
    down = Window.partitionBy(*by).orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = tests.withColumns({"_rank": F.row_number().over(up), "_m": F.count("*").over(Window.partitionBy(*by))})
    return t.withColumn("q_value", F.least(F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down), F.lit(1.0))).drop("_rank", "_m")
