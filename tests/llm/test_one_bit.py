"""One-bit codes against brute force."""

import math

import numpy as np
import pytest

from ledgerline.llm import one_bit
from pyspark.sql import functions as F

CLASHES = "uid id vector bits length agreement rank score query_id q_uid size count".split()
SCHEMA = "vec_id long, embedding array<double>, " + ", ".join(f"{c} int" for c in CLASHES)


def table(spark, rows):
    return spark.createDataFrame([(i, v, *range(len(CLASHES))) for i, v in rows], SCHEMA)


def usable(v, size):
    return v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, size, k=10, every=100):
    kept = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if usable(v, size)]
    out = []
    for n, i, v in kept:
        if i is not None and i % every == 0:
            near = sorted((math.sqrt(((w - v) ** 2).sum()), j is None, j or 0, j) for m, j, w in kept if m != n)[:k]
            out += [(i, r + 1, j, round(d, 9)) for r, (d, _, _, j) in enumerate(near)]
    return sorted(out, key=repr)


def found(df, every=100, **more):
    index, coder = one_bit.build_index(df)
    return sorted(((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in one_bit.nearest(index, coder, F.col("id") % every == 0, **more).collect()), key=repr)


def test_equals_brute_force_with_clusters_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(6, 24))
    rows = [(k, (middles[k % 6] + 0.6 * rng.normal(size=24)).tolist()) for k in range(1500)]
    rows += [(2000 + k, rows[0][1]) for k in range(700)]  # a third of all rows is one vector: ties go to the smaller id
    rows += [(100, rows[5][1]), (100, rows[5][1]), (None, rows[7][1]), (None, rows[200][1])]  # repeated and null keys
    rows += [(3000, None), (3100, [0.0] * 24), (3200, [None, *[1.0] * 23]), (3300, [float("nan"), *[1.0] * 23]), (3400, [float("inf"), *[1.0] * 23]), (3500, [1.0] * 5), (3600, [])]
    assert found(table(spark, rows)) == brute(rows, 24)


def test_queries_in_groups_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(1200)]
    monkeypatch.setattr(one_bit, "QUERY_BYTES", 50 * 16 * 8)
    monkeypatch.setattr(one_bit, "PART_ROWS", 100)
    monkeypatch.setattr(one_bit, "_PAIRS", 37)
    assert found(table(spark, rows), every=7) == brute(rows, 16, every=7)


@pytest.mark.parametrize("size", [1, 2, 3, 9, 130])
def test_sizes(spark, size):
    rng = np.random.default_rng(size)
    rows = [(k, rng.normal(size=size).tolist()) for k in range(300)]
    assert found(table(spark, rows), every=20) == brute(rows, size, every=20)


def test_few_rows_and_far_values(spark):
    assert found(table(spark, [])) == [] and found(table(spark, [(0, [1.0, 2.0])])) == []
    assert found(table(spark, [(0, None)])) == []
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (200, [3.0, 2.0])]
    assert found(table(spark, rows)) == brute(rows, 2)
    far = [(0, [1e200, 1.0]), (1, [-1e200, 1.0]), (2, [1.0, 1.0]), (100, [1.0, 2.0])]  # squares overflow: infinitely far, but found
    with np.errstate(over="ignore"):
        assert found(table(spark, far)) == brute(far, 2)


def test_bounds_hold_and_pass_over_most_rows():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4000, 64))
    coder = one_bit.Coder(v.mean(axis=0))
    q = v[:50]
    o = coder.offsets(q)
    low, high = coder.bounds(*coder.encode(v), o.astype(np.float32), np.sqrt((o * o).sum(axis=1)), one_bit.EPSILON)
    true = ((q[:, None] - v[None]) ** 2).sum(axis=2)
    outside = ((true < low) | (true > high)).mean()
    assert outside < 0.01
    search = one_bit.Search(coder, np.arange(50), q, 10, one_bit.EPSILON)
    bits, length, agreement = coder.encode(v)
    ids = np.arange(4000)
    for at in range(0, 4000, 1000):
        s = slice(at, at + 1000)
        search.meet(ids[s], ids[s], np.zeros(1000, bool), v[s], bits[s], length[s], agreement[s])
    np.fill_diagonal(true, np.inf)
    want = np.argsort(true, axis=1, kind="stable")[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(search.rank, want)])
    assert recall >= 0.99 and search.reranked < 0.6 * 50 * 4000
