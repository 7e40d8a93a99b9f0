"""Entity embeddings from document embeddings, and their similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.vectors import clipped_cosine, norm

#: Vectors that a task holds sums of before it passes them on.
_HELD = 4096


def aggregate_universe(docs: DataFrame, as_of: DataFrame, mode: str = "mean", halflife: int = 365, min_documents: int = 1) -> DataFrame:
    """(as_of, ticker, n_documents, embedding): unit vector of each ticker's documents dated on or before as_of.

    mean pools the raw vectors; time_weighted weighs each by 0.5 ** (age in days / halflife). docs: (ticker, doc_date,
    embedding); as_of (one row a date) is small. A document counts once, at the first date it is known at: tasks
    add up what they read for each ticker and date, those sums are added, and a ticker's are carried on from date to
    date, decayed by the days between. So a date costs one vector a ticker, and no weight is ever above 1. Documents
    without a ticker, date or vector are left out; all vectors must be of one size.
    """
    if mode not in ("mean", "time_weighted"):
        raise ValueError(f"unknown aggregation: {mode}")
    dates = sorted(r.as_of for r in as_of.select("as_of").distinct().collect() if r.as_of)  # one a rebalance
    rate = math.log(2.0) / halflife if mode == "time_weighted" else 0.0
    days = np.array([d.toordinal() for d in dates])
    rows = docs.where(F.col("ticker").isNotNull() & F.col("doc_date").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.select("ticker", F.datediff("doc_date", F.lit("1970-01-01").cast("date")).alias("day"), F.col("embedding").cast("array<double>").alias("v"))
    schema = "ticker string, q int, w double, n long, v array<double>"

    def read(batches: Iterator) -> Iterator:
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            day = b.column(1).to_numpy() + 719163  # as date.toordinal() counts
            q = np.searchsorted(days, day)
            known = q < len(days)
            w = np.exp(-rate * (days[np.minimum(q, len(days) - 1)] - day)) if len(days) else np.zeros(len(q))
            names, code = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            for key in np.unique((code * np.int64(len(days) + 1) + q)[known]):
                on = known & (code * np.int64(len(days) + 1) + q == key)
                at = (names[key // (len(days) + 1)], int(key % (len(days) + 1)))
                s = held.setdefault(at, [0.0, 0, np.zeros(v.shape[1])])
                s[0], s[1], s[2] = s[0] + w[on].sum(), s[1] + int(on.sum()), s[2] + w[on] @ v[on]
            if len(held) >= _HELD:
                yield _sums(held)
                held = {}
        if held:
            yield _sums(held)

    def add(key, t):  # noqa: ANN001, ANN202
        import pyarrow as pa

        total = _vectors(t).sum(axis=0)
        return pa.table({"ticker": [key[0].as_py()], "q": pa.array([key[1].as_py()], pa.int32()), "w": [float(t["w"].to_numpy().sum())], "n": [int(t["n"].to_numpy().sum())], "v": [total]})

    kind = dict(as_of.dtypes)["as_of"]

    def carry(key, t):  # noqa: ANN001, ANN202
        import pyarrow as pa

        order = np.argsort(t["q"].to_numpy())
        v, w, n, q = _vectors(t), t["w"].to_numpy(), t["n"].to_numpy(), t["q"].to_numpy()
        out, s, weight, count, at = [], np.zeros(v.shape[1]), 0.0, 0, 0
        for k in range(int(q.min()), len(days)):
            fade = math.exp(-rate * (days[k] - days[k - 1])) if count else 1.0
            s, weight = s * fade, weight * fade
            if at < len(order) and q[order[at]] == k:
                i = order[at]
                s, weight, count, at = s + v[i], weight + w[i], count + int(n[i]), at + 1
            mean = s / weight if weight > 0 else s
            norm = float(np.sqrt((mean * mean).sum()))
            out.append((dates[k], count, mean / norm if norm > 0 else mean))
        return pa.table({"as_of": pa.array([d for d, _, _ in out]), "ticker": [key[0].as_py()] * len(out), "n_documents": pa.array([n for _, n, _ in out], pa.int64()), "embedding": pa.array([e for _, _, e in out], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(read, schema).groupBy("ticker", "q").applyInArrow(add, schema)
    e = sums.groupBy("ticker").applyInArrow(carry, f"as_of {kind}, ticker string, n_documents long, embedding array<double>")
    return e.where(F.col("n_documents") >= min_documents)


def _sums(held: dict):  # noqa: ANN202
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), pa.array([float(s[0]) for s in held.values()]), pa.array([s[1] for s in held.values()], pa.int64()), pa.array([s[2] for s in held.values()], pa.list_(pa.float64()))], names=["ticker", "q", "w", "n", "v"])


def _vectors(t) -> np.ndarray:  # noqa: ANN001
    return t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def document_norms(docs: DataFrame) -> DataFrame:
    return docs.withColumn("norm", norm(F.col("embedding")))


def cosine_pairs(firms: DataFrame) -> DataFrame:
    """(as_of, a, b, cosine) of every two tickers of a date, a < b."""
    a = firms.select("as_of", F.col("ticker").alias("a"), F.col("embedding").alias("ea"))
    b = firms.select("as_of", F.col("ticker").alias("b"), F.col("embedding").alias("eb"))
    return a.join(b, "as_of").where("a < b").select("as_of", "a", "b", clipped_cosine(F.col("ea"), F.col("eb")).alias("cosine"))


def sector_pairs(pairs: DataFrame, sectors: DataFrame) -> DataFrame:
    """pairs with same_sector: true if both sectors are known and equal."""
    s = F.broadcast(sectors)
    p = pairs.join(s.select(F.col("ticker").alias("a"), F.col("sector").alias("sa")), "a", "left").join(s.select(F.col("ticker").alias("b"), F.col("sector").alias("sb")), "b", "left")
    return p.withColumn("same_sector", F.coalesce(F.col("sa") == F.col("sb"), F.lit(False))).drop("sa", "sb")


def disagreements(pairs: DataFrame, n: int = 20) -> DataFrame:
    """The n least similar pairs of one sector and the n most similar ones of different sectors."""
    low = pairs.where("same_sector").orderBy("cosine", "a", "b", "as_of").limit(n)
    high = pairs.where("NOT same_sector").orderBy(F.col("cosine").desc(), "a", "b", "as_of").limit(n)
    return low.unionByName(high)


def shuffled(firms: DataFrame, seed: int) -> DataFrame:
    """Placebo: each date's embeddings dealt anew among its tickers, by a hash of seed and ticker."""
    by_name, by_hash = Window.partitionBy("as_of").orderBy("ticker"), Window.partitionBy("as_of").orderBy(F.xxhash64(F.lit(seed), "as_of", "ticker"), "ticker")
    names = firms.select("as_of", "ticker", F.row_number().over(by_name).alias("n"))
    vectors = firms.select("as_of", "n_documents", "embedding", F.row_number().over(by_hash).alias("n"))
    return names.join(vectors, ["as_of", "n"]).drop("n")
