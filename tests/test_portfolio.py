"""Weights of many strategies in one task against each alone, lookbacks as slices of one window, audits and equal shares."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from ledgerline.operators import audit, portfolio, universe
from ledgerline.operators.portfolio import strategy

DATES = [dt.date(2020, 1, 1), dt.date(2020, 4, 1)]
TICKERS = [f"T{k}" for k in range(7)]


@pytest.fixture(scope="module")
def section(spark):
    rng = np.random.default_rng(5)
    rows = [(d, t, i, float(rng.normal(0, 0.02))) for d, end in zip(DATES, (40, 60)) for t in TICKERS for i in range(end - 40, end) if rng.random() < 0.9]
    e = {t: rng.normal(size=5) for t in TICKERS}
    facts = [(d, t, (e[t] / np.linalg.norm(e[t])).tolist(), t[1] if t != "T3" else None, end) for d, end in zip(DATES, (40, 60)) for t in TICKERS]
    return spark.createDataFrame(rows, "rebal_date date, ticker string, date_idx int, x double"), spark.createDataFrame(facts, "rebal_date date, ticker string, embedding array<double>, sector string, t_idx int")


def table(df):
    return {(r.strategy, r.rebal_date, r.ticker): r.weight for r in df.collect()}


def test_strategies_of_one_task_equal_each_alone(section):
    window, facts = section
    grid = [strategy(f"s{k}", c) for k, c in enumerate(["semantic", "ledoit_wolf", "equal", "sample", "cosine", "sector", "text_only", "blended", "semantic", "pca"])]
    assert len(grid) > portfolio.PER_TASK
    whole = table(portfolio.weights(window, facts, grid))
    assert len(whole) == len(grid) * len(DATES) * len(TICKERS)
    for s in grid:
        alone = table(portfolio.weights(window, facts, [s]))
        assert all(abs(whole[k] - w) < 1e-12 for k, w in alone.items())


def test_facts_of_their_own_strategy(section):
    window, facts = section
    few = facts.where("ticker < 'T4'")
    own = facts.selectExpr("'all' AS strategy", "*").unionByName(few.selectExpr("'few' AS strategy", "*")).unionByName(few.selectExpr("'unknown' AS strategy", "*"))
    got = table(portfolio.weights(window, own, [strategy("all", "ledoit_wolf"), strategy("few", "ledoit_wolf")]))
    assert {k[0] for k in got} == {"all", "few"}
    for name, f in (("all", facts), ("few", few)):
        want = table(portfolio.weights(window, f, [strategy(name, "ledoit_wolf")]))
        assert {k: v for k, v in got.items() if k[0] == name}.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_lookbacks_are_the_last_days_of_one_window(section):
    window, facts = section
    got = table(portfolio.weights(window, facts, [strategy(str(n), "ledoit_wolf") | {"days": n} for n in (4, 12, 25, 40, 99)]))
    ends = dict(zip(DATES, (40, 60)))
    for n in (4, 12, 25, 40, 99):
        cut = window.toPandas()
        cut = cut[cut["date_idx"] >= cut["rebal_date"].map(ends) - n]
        want = table(portfolio.weights(window.sparkSession.createDataFrame(cut, window.schema), facts, [strategy(str(n), "ledoit_wolf") | {"days": 999 if n > 4 else 4}]))
        mine = {k: v for k, v in got.items() if k[0] == str(n)}
        assert mine.keys() == want.keys() and all(abs(mine[k] - v) < 1e-12 for k, v in want.items()) and len(mine) == 14


def test_days_without_a_return_of_the_section_are_no_days():
    w = pd.DataFrame({"date_idx": [1, 1, 2, 3], "ticker": ["A", "X", "X", "A"], "x": [0.1, 0.2, 0.3, 0.4]})
    f = pd.DataFrame({"ticker": ["B", "A"], "embedding": [[1.0], [1.0]], "sector": [None, "1"]})
    s = portfolio.Section(w, f)
    assert s.tickers == ["A", "B"] and s.x.shape == (2, 2) and np.isnan(s.x[:, 1]).all() and s.sectors == ["1", None]


def test_split_audit(spark):
    day = dt.date
    events = audit.known_splits(spark).unionByName(spark.createDataFrame([("A", day(2020, 8, 29), "2:1"), ("B", day(2020, 8, 31), "2:1"), ("C", day(2020, 1, 1), "2:1")], "ticker string, event_date date, ratio string"))
    returns = spark.createDataFrame([("A", day(2020, 8, 31), 0.01), ("A", day(2020, 9, 1), 0.9), ("B", day(2020, 8, 31), -0.7), ("C", day(2020, 3, 1), 0.0), ("SHW", day(2024, 9, 18), 0.02)], "ticker string, date date, log_ret double")
    a = audit.split_audit(events, returns)
    got = {(r.ticker, r.ratio): (r.status, r.actual_date) for r in a.where("status <> 'NO_DATA'").collect()}
    assert got == {("A", "2:1"): ("PASS", day(2020, 8, 31)), ("B", "2:1"): ("FAIL_SPIKE", day(2020, 8, 31)), ("C", "2:1"): ("DATE_NOT_FOUND", None), ("SHW", "4:1"): ("PASS", day(2024, 9, 18))}
    assert tuple(audit.split_verdict(a).first()) == (12, 3, 2, 1, "FAIL")
    assert audit.split_verdict(a.where("ticker = 'A'")).first().verdict == "PASS" and audit.split_verdict(a.where("ticker = 'C'")).first().verdict == "FAIL"


def test_presence(spark):
    day = dt.date
    names = spark.createDataFrame([(x,) for x in ("LEH", "AIG", "GM", "LEH")], "ticker string")
    prices = spark.createDataFrame([("LEH", day(2008, 9, 12), 3.6), ("LEH", day(2008, 9, 15), None), ("AIG", day(2020, 1, 2), 50.0)], "ticker string, date date, close double")
    members = spark.createDataFrame([(day(2008, 1, 1), "LEH"), (day(2008, 4, 1), "LEH")], "rebal_date date, ticker string")
    got = {r.ticker: tuple(r)[1:] for r in audit.presence(names, prices, names.where("ticker = 'GM'"), members).collect()}
    assert got == {"LEH": (True, False, True, day(2008, 9, 12), day(2008, 1, 1), day(2008, 4, 1), 2), "AIG": (True, False, False, day(2020, 1, 2), None, None, 0), "GM": (False, True, False, None, None, None, 0)}


def test_history_buckets(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 62, 63, 125, 126, 251, 252, None)], "n_ret long")
    assert [r.bucket for r in universe.history_buckets(rows).collect()] == ["<63", "<63", "<126", "<126", "<252", "<252", ">=252", ">=252"]
