"""Entity embeddings as of each date against recounting, whatever the half-life and however documents are dealt out."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from ledgerline.operators import embed
from pyspark.sql import functions as F

DATES = ["2001-03-31", "2020-06-30", "2020-09-30", "2024-12-31"]


def rows(n=200, dim=6):
    rnd = random.Random(9)
    days = [f"{y}-0{m}-11" for y in (1995, 2001, 2020, 2024, 2025) for m in (1, 4, 7, 9)]
    out = [(rnd.choice(["A", "B", "Ü"]), rnd.choice(days), [rnd.gauss(0, 1) for _ in range(dim)]) for _ in range(n)]
    return [*out, ("LATE", "2025-09-01", [1.0] * dim), ("ZERO", "2001-01-01", [0.0] * dim), (None, "2001-01-01", [1.0] * dim), ("A", None, [1.0] * dim), ("A", "2001-01-01", None)]


def plain(data, mode, halflife):
    out = {}
    for d in map(dt.date.fromisoformat, DATES):
        for t in {r[0] for r in data if r[0]}:
            known = [(dt.date.fromisoformat(day), np.array(v)) for ticker, day, v in data if ticker == t and day and v and dt.date.fromisoformat(day) <= d]
            if known:
                w = np.array([0.5 ** ((d - day).days / halflife) if mode == "time_weighted" else 1.0 for day, _ in known])
                m = sum(a * v for a, (_, v) in zip(w, known)) / w.sum() if w.sum() else known[0][1] * 0
                n = np.linalg.norm(m)
                out[d, t] = (len(known), m / n if n else m)
    return out


@pytest.mark.parametrize("mode,halflife", [("mean", 365), ("time_weighted", 365), ("time_weighted", 30)])
def test_equals_recounting_each_date(spark, mode, halflife, monkeypatch):
    monkeypatch.setattr(embed, "_HELD", 3)
    data = rows()
    docs = spark.createDataFrame(data, "ticker string, day string, embedding array<double>").select("ticker", F.to_date("day").alias("doc_date"), "embedding").repartition(5)
    as_of = spark.createDataFrame([(d,) for d in [*DATES, DATES[1], None]], "d string").select(F.to_date("d").alias("as_of"))
    got = {(r.as_of, r.ticker): (r.n_documents, np.array(r.embedding)) for r in embed.aggregate_universe(docs, as_of, mode, halflife).collect()}
    want = plain(data, mode, halflife)
    assert got.keys() == want.keys()
    for k, (n, v) in want.items():
        assert got[k][0] == n and np.allclose(got[k][1], v, atol=1e-9), k
    assert embed.aggregate_universe(docs, as_of, mode, halflife, min_documents=5).where("n_documents < 5").count() == 0


def test_short_half_lives_far_from_any_epoch(spark):
    """A half-life of a day over decades: the newest document alone counts, nothing overflows."""
    data = [("A", f"{y}-01-01", [float(y), 1.0, 0.0]) for y in range(1950, 2026)]
    docs = spark.createDataFrame(data, "ticker string, day string, embedding array<double>").select("ticker", F.to_date("day").alias("doc_date"), "embedding")
    as_of = spark.createDataFrame([("1960-01-02",), ("2026-01-01",)], "d string").select(F.to_date("d").alias("as_of"))
    got = {str(r.as_of): r.embedding for r in embed.aggregate_universe(docs, as_of, "time_weighted", 1).collect()}
    for d, y in (("1960-01-02", 1960), ("2026-01-01", 2025)):
        assert np.allclose(got[d], np.array([y, 1.0, 0.0]) / math.hypot(y, 1.0), atol=1e-9)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "ticker string, doc_date date, embedding array<double>")
    as_of = spark.createDataFrame([(dt.date(2020, 1, 1),)], "as_of date")
    assert embed.aggregate_universe(docs, as_of).count() == 0
    some = spark.createDataFrame([("A", dt.date(2019, 1, 1), [1.0])], docs.schema)
    assert embed.aggregate_universe(some, as_of.limit(0)).count() == 0
