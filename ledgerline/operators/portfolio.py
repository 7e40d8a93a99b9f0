"""Estimators and portfolios per date: one grouped task gets a date's returns, embeddings and sectors.

A group holds one cross-section (tickers times lookback), which is what a dense covariance needs anyway; dates and
strategies run side by side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import kernels, optimize


class Section:
    """A date's cross-section: sorted tickers, x (days by tickers, NaN where missing; days on which one has a return), e (unit embeddings), sectors.

    window may hold other tickers too; days keeps its last days before t_idx, which facts have then.
    """

    def __init__(self, window: pd.DataFrame, facts: pd.DataFrame, days: int | None = None) -> None:
        facts = facts.sort_values("ticker")
        self.tickers = facts["ticker"].tolist()
        if days is not None and len(facts):
            window = window[window["date_idx"] >= facts["t_idx"].iloc[0] - days]
        w = window.pivot(index="date_idx", columns="ticker", values="x") if len(window) else pd.DataFrame()
        x = w.reindex(columns=self.tickers).to_numpy(float)
        self.x = x[~np.isnan(x).all(axis=1)] if x.size else x
        self.filled = np.nan_to_num(self.x)
        self.e = np.array(facts["embedding"].tolist(), float) if len(facts) and facts["embedding"].iloc[0] is not None else np.zeros((len(facts), 1))
        self.sectors = [None if s is None or s != s else s for s in facts["sector"]]
        self.mu = self.filled.mean(axis=0) if len(self.x) else np.zeros(len(self.tickers))

    def ok(self, days: int = 10, tickers: int = 2) -> bool:
        return len(self.x) >= days and len(self.tickers) >= tickers


def per_date(window: DataFrame, facts: DataFrame, f: Callable[[object, Section], pd.DataFrame], schema: str) -> DataFrame:
    """f(date, section) for each date of facts (rebal_date, ticker, embedding, sector) with its window rows."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        if not len(right):
            return pd.DataFrame()
        return f(key[0], Section(left, right))

    kept = window.join(facts.select("rebal_date", "ticker"), ["rebal_date", "ticker"], "left_semi")
    return kept.groupBy("rebal_date").cogroup(facts.groupBy("rebal_date")).applyInPandas(run, schema)


#: Covariances by name, of a section; estimator() adds to them.
COVARIANCES: dict[str, Callable[[Section], np.ndarray]] = {
    "text_only": lambda s: kernels.cosine_covariance(s.e),
    "sample": lambda s: kernels.nearest_psd(kernels.sample(s.filled)),
    "ledoit_wolf": lambda s: kernels.lw_covariance(s.filled)[0],
    "cosine": lambda s: kernels.cosine_covariance(s.e, s.filled.std(axis=0, ddof=1)),
    "semantic": lambda s: kernels.shrunk(s.filled, kernels.cosine(s.e))[0],
    "semantic_cv": lambda s: kernels.shrunk(s.filled, kernels.cosine(s.e), "cv")[0],
    "pca": lambda s: kernels.shrunk(s.filled, kernels.factor_correlation(s.e, 10)[0])[0],
    "multi_target_cv": lambda s: kernels.multi_target(s.filled, s.e, s.sectors)[0],
    "multi_target_frobenius": lambda s: kernels.multi_target(s.filled, s.e, s.sectors, "frobenius")[0],
    "sector": lambda s: kernels.nearest_psd(kernels.spread(kernels.sector_correlation(s.sectors), kernels.sample(s.filled))),
    "blended": lambda s: kernels.blended(s.x, (~np.isnan(s.x)).sum(axis=0) >= 0.9 * len(s.x), s.sectors),
}


def estimator(name: str) -> Callable:
    """Registers a function of a section that gives its covariance, for strategies to name."""

    def add(f: Callable[[Section], np.ndarray]) -> Callable[[Section], np.ndarray]:
        if name in COVARIANCES:
            raise ValueError(f"there is a covariance {name} already")
        COVARIANCES[name] = f
        return f

    return add


def sector_weights(weights: DataFrame, sectors: DataFrame) -> DataFrame:
    """(strategy, rebal_date, n_sectors, top_sector, top_weight): weights summed by sector (unknown is one), the heaviest of them."""
    w = weights.join(F.broadcast(sectors), "ticker", "left").groupBy("strategy", "rebal_date", F.coalesce("sector", F.lit("_unknown")).alias("sector")).agg(F.sum("weight").alias("w"))
    top = F.max_by("sector", F.struct(F.round("w", 9), "sector"))
    return w.groupBy("strategy", "rebal_date").agg(F.count("*").alias("n_sectors"), top.alias("top_sector"), F.max("w").alias("top_weight"))


def covariance(window: DataFrame, facts: DataFrame, names: list[str]) -> DataFrame:
    """(rebal_date, method, a, b, cov), a <= b."""

    def f(date, s: Section) -> pd.DataFrame:  # noqa: ANN001
        if not s.ok():
            return pd.DataFrame()
        i, j = np.triu_indices(len(s.tickers))
        t = np.array(s.tickers, object)
        return pd.concat([pd.DataFrame({"rebal_date": date, "method": n, "a": t[i], "b": t[j], "cov": COVARIANCES[n](s)[i, j]}) for n in names])

    return per_date(window, facts, f, "rebal_date date, method string, a string, b string, cov double")


def strategy(name: str, cov: str = "semantic", objective: str = "min_variance", cap: float = 0.10, sector_cap: float | None = None, vol_target: float | None = None, alpha: float | str | None = None, k: int | None = None, days: int | None = None) -> dict:
    """What weights() needs to know of a strategy; alpha fixes the shrinkage toward the cosine target, k its factors, days its lookback (else all of the window)."""
    return locals()


def section_weights(s: Section, p: dict) -> tuple[np.ndarray, dict]:
    if p["cov"] == "equal":
        w, about = np.full(len(s.tickers), 1 / len(s.tickers)), {}
        if p["sector_cap"]:
            w, about["groups_kept"] = optimize.capped_equal_weights(s.sectors, {x or "_unknown": p["sector_cap"] for x in s.sectors})
        if p["vol_target"]:  # scaled by the sample covariance's forecast, up or down
            forecast = float(np.sqrt(252 * w @ kernels.sample(s.filled) @ w))
            if forecast > 1e-10:
                about["vol_scale"] = p["vol_target"] / forecast
                w = w * about["vol_scale"]
        return w, about
    if p["alpha"] is not None or p["k"] is not None:
        target = kernels.cosine(s.e) if p["k"] is None else kernels.factor_correlation(s.e, p["k"])[0]
        sigma = kernels.shrunk(s.filled, target, "auto" if p["alpha"] is None else p["alpha"])[0]
    else:
        sigma = COVARIANCES[p["cov"]](s)
    groups = None
    if p["sector_cap"]:
        names = [x or f"_unk_{t}" for x, t in zip(s.sectors, s.tickers)]
        groups = [(np.array([i for i, y in enumerate(names) if y == x]), p["sector_cap"]) for x in sorted(set(names))]
    return optimize.optimise(sigma, s.mu, p["objective"], p["cap"], groups=groups, vol_target=p["vol_target"])


#: Strategies that one task makes the weights of, for one date.
PER_TASK = 8


def weights(window: DataFrame, facts: DataFrame, strategies: list[dict], least: int = 2) -> DataFrame:
    """(strategy, rebal_date, ticker, weight) of every strategy and date; dates with too few tickers or days have none.

    A task gets a date's window once and makes the weights of up to PER_TASK strategies from it, so a window travels
    once for so many, and a long grid still spreads over the cluster. Facts with a column strategy are those of that
    strategy alone; strategies with a lookback of their own (days) need facts with t_idx, the date's place.
    """
    by_name = {p["name"]: p for p in strategies}
    part_of = {n: k // PER_TASK for k, n in enumerate(by_name)}
    parts = max(part_of.values(), default=0) + 1
    own_facts = "strategy" in facts.columns
    if own_facts:
        named = F.create_map(*[F.lit(x) for n, k in part_of.items() for x in (n, k)])
        facts = facts.where(F.col("strategy").isin(*by_name)).withColumn("part", F.element_at(named, F.col("strategy")))
    else:
        facts = facts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kept = window.join(facts.select(F.col("part").alias("of"), "rebal_date", "ticker").distinct(), ["rebal_date", "ticker"]).withColumnRenamed("of", "part")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        made, sections = [], {}
        for n, p in by_name.items():
            if part_of[n] != key[1]:
                continue
            of, days = (n if own_facts else None), p["days"]
            if (of, days) not in sections:
                mine = right[right["strategy"] == n] if own_facts else right
                sections = {(of, days): Section(left, mine, days)}  # one is held at a time
            s = sections[of, days]
            if s.ok(min(10, days or 10), least):
                made.append(pd.DataFrame({"strategy": n, "rebal_date": key[0], "ticker": s.tickers, "weight": section_weights(s, p)[0]}))
        return pd.concat(made) if made else pd.DataFrame()

    return kept.groupBy("rebal_date", "part").cogroup(facts.groupBy("rebal_date", "part")).applyInPandas(run, "strategy string, rebal_date date, ticker string, weight double")
