"""Registered queries do the whole job: all pairs, all draws."""

import inspect
import random

from ledgerline.operators import inference
from ledgerline.plans import registry, similarity


def test_tau_takes_all_pairs(spark, monkeypatch):
    rnd = random.Random(3)
    names = [f"Brand#{k}" for k in range(1, 8)]
    rows = [(date, a, b, rnd.randrange(5) / 4, rnd.randrange(5) / 4) for date in "de" for a in names for b in names if a < b]
    monkeypatch.setattr(similarity, "correlation_pairs", lambda s, d: s.createDataFrame(rows, "rebal_date string, a string, b string, x double, y double"))
    got = {r.rebal_date: r.tau for r in registry.queries()["kendall_tau_pairs"](spark, "").collect()}
    sign = lambda v: (v > 0) - (v < 0)
    for date in "de":
        p = [r[3:] for r in rows if r[0] == date]
        s = [(sign(u[0] - v[0]), sign(u[1] - v[1])) for i, u in enumerate(p) for v in p[:i]]
        want = sum(x * y for x, y in s) / (sum(x * x for x, _ in s) * sum(y * y for _, y in s)) ** 0.5
        assert len(p) == 21 and abs(got[date] - want) < 1e-6


def test_resampling_takes_the_default_draws(spark, monkeypatch):
    from ledgerline.plans import experiments
    from ledgerline.plans import inference as plans

    took = []
    sign = inspect.signature(inference.pair_tests)

    def spy(*args, **more):
        b = sign.bind(*args, **more)
        b.apply_defaults()
        took.append(b.arguments["draws"])
        return spark.range(1)

    monkeypatch.setattr(inference, "pair_tests", spy)
    monkeypatch.setattr(plans, "brand_returns", lambda s, d: None)
    monkeypatch.setattr(experiments, "walk", lambda *a, **k: (None, None))
    for name in ("block_permutation_bootstrap", "block_sensitivity", "walk_forward_tests"):
        registry.queries()[name](spark, "")
    assert took == [10_000] * 3


def test_placebo_is_of_backtests(spark, monkeypatch):
    from ledgerline.operators import metrics
    from ledgerline.plans import experiments, kernels, market

    vectors = {f"t{k}": [float(k), 1.0] for k in range(6)}
    monkeypatch.setattr(market, "members", lambda s, d, n=None: n)
    monkeypatch.setattr(kernels, "facts", lambda s, d, n: s.createDataFrame([(date, t, v, "x") for date in ("d", "e") for t, v in list(vectors.items())[: 2 + n // 10]], "rebal_date string, ticker string, embedding array<double>, sector string"))
    rnd, kept = random.Random(5), {}

    def walk(s, d, strategies, facts):
        kept["facts"] = facts.collect()
        rows = [(p["name"], i, rnd.gauss(0.001, 0.01)) for p in strategies for i in range(120)]
        kept["returns"] = s.createDataFrame(rows, "strategy string, i int, ret double").selectExpr("strategy", "date_add(DATE'2020-01-01', i) AS date", "ret")
        return None, kept["returns"]

    monkeypatch.setattr(experiments, "walk", walk)
    got = {r["size"]: r for r in registry.queries()["shuffle_placebo"](spark, "").collect()}
    sharpe = {r.strategy: r.sharpe_ratio for r in metrics.performance(kept["returns"]).collect()}
    for size in (12, 15, 20, 25):
        fake = [sharpe[f"{size}/{k}"] for k in range(10)]
        mean = sum(fake) / 10
        sd = (sum((x - mean) ** 2 for x in fake) / 10) ** 0.5
        real = sharpe[f"{size}/real"]
        assert got[size].n_shuffles == 10 and abs(got[size].z - (real - mean) / sd) < 1e-5 and got[size].p == sum(x >= real for x in fake) / 10
    deals = {}
    for r in kept["facts"]:
        deals.setdefault((r.strategy, r.rebal_date), {})[r.ticker] = tuple(r.embedding)
    assert len(deals) == 88
    for (name, date), dealt in deals.items():
        real = deals[f"{name.split('/')[0]}/real", date]
        assert real == {t: tuple(vectors[t]) for t in real} and dealt.keys() == real.keys() and sorted(dealt.values()) == sorted(real.values())
    assert len({tuple(sorted(x.items())) for (n, _), x in deals.items() if n.startswith("20/")}) > 5


def test_weights_of_strategies_with_facts_of_their_own(spark):
    from pyspark.sql import functions as F

    from ledgerline.operators import portfolio

    rnd = random.Random(6)
    window = spark.createDataFrame([("d", f"t{k}", i, rnd.gauss(0, 0.01 * (k + 1))) for k in range(5) for i in range(40)], "rebal_date string, ticker string, date_idx int, x double").withColumn("rebal_date", F.lit("2020-01-01").cast("date"))
    facts = spark.createDataFrame([(f"t{k}", [float(k), 1.0], "x") for k in range(5)], "ticker string, embedding array<double>, sector string").withColumn("rebal_date", F.lit("2020-01-01").cast("date"))
    few = facts.where("ticker <> 't0'")
    both = facts.withColumn("strategy", F.lit("a")).unionByName(few.withColumn("strategy", F.lit("b")))
    s = [portfolio.strategy("a", cap=0.5), portfolio.strategy("b", cap=0.5)]
    rows = lambda df: sorted(map(tuple, df.select("strategy", "ticker", "weight").collect()))
    assert rows(portfolio.weights(window, both, s)) == rows(portfolio.weights(window, facts, s[:1]).unionByName(portfolio.weights(window, few, s[1:])))
