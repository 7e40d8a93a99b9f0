"""Composite studies: each is one lazy plan over (strategy or parameter, rebalance date), reduced to a small table."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import backtest, covariance, embed, inference, kernels, metrics, panel, portfolio, rank, tfidf, universe
from ledgerline.operators.portfolio import strategy
from ledgerline.plans import kernels as k
from ledgerline.plans import market
from ledgerline.plans import tables as t
from ledgerline.plans.registry import query, rounded
from ledgerline.session import cut

ALPHA_GRID = (0.0, 0.25, 0.5, 0.75, 1.0)
MULTIPLIERS = (0.5, 1.0, 1.5, 2.0)
K_GRID = (1, 3, 5, 10, 20, 50, 100)  # more factors than tickers are all of them
LOOKBACKS = (5, 10, 21, 42, 63, 104, 126, 252, 504)
TFIDF_FEATURES = 768
COMPONENTS = 10
PLACEBO_SIZES, SHUFFLES = (12, 15, 20, 25), 10
EW = strategy("equal_weight", "equal")
LW = strategy("ledoit_wolf", "ledoit_wolf")
SEMANTIC = strategy("semantic")


def with_equal(weights: DataFrame, members: DataFrame) -> DataFrame:
    return weights.unionByName(market.equal_weights(members))


def walk(spark: SparkSession, d: str, strategies: list[dict], facts: DataFrame | None = None, lookback: int = k.LOOKBACK, window: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(weights, daily returns after tiered costs) of strategies over all rebalance dates."""
    facts = k.facts(spark, d) if facts is None else facts
    window = k.window(spark, d, lookback) if window is None else window
    # grouped Python work is done once: what follows reads its result several times
    w = cut(portfolio.weights(window, facts, strategies, least=5))
    return w, cut(backtest.run(w, cut(t.returns(spark, d)), market.periods(spark), market.rates(spark, d)))


def summary(w: DataFrame, r: DataFrame) -> DataFrame:
    return metrics.performance(r).join(backtest.average_turnover(w), "strategy", "left")


@query("walk_forward")
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary(*walk(spark, d, [SEMANTIC, LW, EW])))


@query("walk_forward_tests")
def walk_forward_tests(spark: SparkSession, d: str) -> DataFrame:
    r = walk(spark, d, [SEMANTIC, LW, EW])[1]
    return rounded(inference.pair_tests(r, [("semantic", "ledoit_wolf"), ("semantic", "equal_weight"), ("ledoit_wolf", "equal_weight")]))


def _named(s: dict, prefix: object) -> dict:
    """A strategy under a name of its own in a grid: prefix/name."""
    return s | {"name": f"{prefix}/{s['name']}"}


def _parts(df: DataFrame, kind: str) -> DataFrame:
    """df with prefix (as kind) and strategy from the names of a grid."""
    return df.withColumn("prefix", F.substring_index("strategy", "/", 1).cast(kind)).withColumn("strategy", F.substring_index("strategy", "/", -1))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Daily returns of the strategies size/name: the same ones over the most liquid tickers, all sizes in one walk."""
    facts, names = [], []
    for p in PLACEBO_SIZES:
        f = k.facts(spark, d, market.members(spark, d, p))
        for s in (SEMANTIC, LW, EW):
            names.append(_named(s, p))
            facts.append(f.select(F.lit(names[-1]["name"]).alias("strategy"), "rebal_date", "ticker", "embedding", "sector"))
    return walk(spark, d, names, cut(reduce(DataFrame.unionByName, facts)))[1]


@query("scaling")
def scaling(spark: SparkSession, d: str) -> DataFrame:
    """Universe sizes: the same strategies over the p most liquid tickers."""
    return rounded(_parts(metrics.performance(_sizes(spark, d)), "int").withColumnRenamed("prefix", "p"))


@query("scaling_tests")
def scaling_tests(spark: SparkSession, d: str) -> DataFrame:
    """Block tests of semantic shrinkage against the others at every size; p-values corrected across the sizes of a pair, and across the pairs of a size."""
    pairs = [(f"{p}/semantic", f"{p}/{o}") for p in PLACEBO_SIZES for o in ("ledoit_wolf", "equal_weight")]
    x = inference.pair_tests(_sizes(spark, d), pairs).withColumn("p", F.substring_index("a", "/", 1).cast("int"))
    x = x.withColumns({"a": F.substring_index("a", "/", -1), "b": F.substring_index("b", "/", -1)})
    x = rank.benjamini_hochberg(x, ["b"]).withColumnRenamed("q_value", "q_across_sizes")
    return rounded(rank.benjamini_hochberg(x, ["p"]).withColumnRenamed("q_value", "q_within_size"))


@query("alpha_sweep")
def alpha_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary(*walk(spark, d, [*(strategy(f"alpha_{a:g}", alpha=a) for a in ALPHA_GRID), strategy("alpha_auto", alpha="auto")])))


@query("cv_alpha_experiment")
def cv_alpha_experiment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary(*walk(spark, d, [strategy("cv_alpha", alpha="cv"), *(strategy(f"alpha_{a:.2f}", alpha=a) for a in (0.25, 0.5, 0.75)), strategy("oracle", alpha="auto"), LW, EW])))


@query("multitarget_experiment")
def multitarget_experiment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary(*walk(spark, d, [strategy("mt_cv", "multi_target_cv"), strategy("mt_frob", "multi_target_frobenius"), strategy("semantic_auto"), strategy("sic", "sector"), LW, EW])))


def corrected(returns: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Block tests of pairs of strategies, with p-values corrected for their number."""
    return rank.benjamini_hochberg(inference.pair_tests(returns, pairs).withColumn("family", F.lit("pairs")), ["family"]).drop("family")


@query("multitarget_tests")
def multitarget_tests(spark: SparkSession, d: str) -> DataFrame:
    r = walk(spark, d, [strategy("mt_cv", "multi_target_cv"), strategy("mt_frob", "multi_target_frobenius"), strategy("semantic_auto"), strategy("sic", "sector"), LW, EW])[1]
    return rounded(corrected(r, [(m, o) for m in ("mt_cv", "mt_frob") for o in ("semantic_auto", "sic", "ledoit_wolf", "equal_weight")]))


@query("alpha_sweep_tests")
def alpha_sweep_tests(spark: SparkSession, d: str) -> DataFrame:
    r = walk(spark, d, [*(strategy(f"alpha_{a:g}", alpha=a) for a in ALPHA_GRID), strategy("alpha_auto", alpha="auto"), LW])[1]
    return rounded(corrected(r, [(f"alpha_{a:g}", "ledoit_wolf") for a in ALPHA_GRID] + [("alpha_auto", "ledoit_wolf")]))


@query("pca_k_sweep")
def pca_k_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary(*walk(spark, d, [*(strategy(f"pca_{n}", k=n) for n in K_GRID), SEMANTIC, LW, EW])))


@query("pca_k_tests")
def pca_k_tests(spark: SparkSession, d: str) -> DataFrame:
    """Every number of factors against the full cosine target and Ledoit-Wolf, corrected for the number of tests."""
    r = walk(spark, d, [*(strategy(f"pca_{n}", k=n) for n in K_GRID), SEMANTIC, LW])[1]
    return rounded(corrected(r, [(f"pca_{n}", o) for n in K_GRID for o in ("semantic", "ledoit_wolf")]))


@query("constrained_regimes")
def constrained_regimes(spark: SparkSession, d: str) -> DataFrame:
    s = [strategy("none"), strategy("sector_25", sector_cap=0.25, cap=0.2), strategy("sector_40", sector_cap=0.40, cap=0.2), strategy("vol_10", vol_target=0.10), strategy("ew_vol_10", "equal", vol_target=0.10), strategy("sector_40_vol_10", sector_cap=0.40, cap=0.2, vol_target=0.10), strategy("ew_sector_40", "equal", sector_cap=0.40)]
    return rounded(summary(*walk(spark, d, s)))


@query("lookback_ablation")
def lookback_ablation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_lookbacks(spark, d))


def _lookbacks(spark: SparkSession, d: str) -> DataFrame:
    """Performance by strategy and lookback in weeks; text alone needs no returns and stands at lookback 0.

    One window at the longest lookback, which each strategy takes its own last weeks of.
    """
    some = [strategy("text_vols", "cosine"), SEMANTIC, LW, strategy("sic", "sector"), EW]
    grid = [_named(s, n) | {"days": n} for n in LOOKBACKS for s in some] + [_named(strategy("text_only", "text_only"), 0) | {"days": LOOKBACKS[-1]}]
    facts = k.facts(spark, d).join(F.broadcast(t.places(spark, d)[1]), "rebal_date")
    r = walk(spark, d, grid, facts, LOOKBACKS[-1])[1]
    return _parts(metrics.performance(r), "int").withColumnRenamed("prefix", "lookback")


@query("lookback_crossover")
def lookback_crossover(spark: SparkSession, d: str) -> DataFrame:
    """The lookback from which Ledoit-Wolf does as well as text alone without returns."""
    return metrics.crossover(cut(_lookbacks(spark, d)), "ledoit_wolf", "text_only")


#: Returns in the lookback below which a ticker is young, and from which (with COMPLETE of the days) it is established.
YOUNG, ESTABLISHED, COMPLETE = 26, 63, 0.8


def _late_returns(spark: SparkSession, d: str) -> DataFrame:
    """Returns as if the tickers of the highest brand numbers had been listed one after another, half a year apart."""
    number = F.regexp_extract("ticker", r"(\d+)$", 1).cast("int")
    listed = F.when(number > 20, F.add_months(F.lit("1996-07-01").cast("date"), 6 * (number - 20)))
    return t.returns(spark, d).withColumn("_listed", listed).where("_listed IS NULL OR date >= _listed").drop("_listed")


def _by_history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(window, facts, history) where history (rebal_date, ticker, n_ret, is_young, is_established) follows from the returns in each date's lookback."""
    returns, places = _late_returns(spark, d), t.places(spark, d)[1]
    window = cut(covariance.windowed(returns, places, k.LOOKBACK))
    h = universe.completeness(returns, places, k.LOOKBACK)
    h = h.select("rebal_date", "ticker", "n_ret", (F.col("n_ret") < YOUNG).alias("is_young"), ((F.col("n_ret") >= ESTABLISHED) & (F.col("n_ret") >= COMPLETE * F.col("n_days"))).alias("is_established"))
    h = cut(h)
    h = h.select(*[F.col(c).alias(c) for c in h.columns])  # new names of the same columns: it meets the window
    return window, k.facts(spark, d, h.where("n_ret > 1")), h


def _established(facts: DataFrame, history: DataFrame) -> DataFrame:
    names = history.where("is_established").select(F.col("rebal_date").alias("r"), F.col("ticker").alias("x"))
    return cut(facts.join(names, (F.col("rebal_date") == F.col("r")) & (F.col("ticker") == F.col("x")), "left_semi"))


@query("cold_start")
def cold_start(spark: SparkSession, d: str) -> DataFrame:
    """Portfolios with and without the tickers that have hardly any history at a date; what a ticker's history is, its returns in the lookback say."""
    window, every, h = _by_history(spark, d)
    old = _established(every, h)
    a = walk(spark, d, [strategy("text_inclusive"), strategy("sic_substitute", "blended"), strategy("ew_inclusive", "equal")], every, window=window)[1]
    b = walk(spark, d, [strategy("text_exclusive"), strategy("lw_exclusive", "ledoit_wolf"), strategy("ew_established", "equal")], old, window=window)[1]
    return rounded(metrics.performance(a.unionByName(b)))


@query("cold_start_tests")
def cold_start_tests(spark: SparkSession, d: str) -> DataFrame:
    """Inclusive against exclusive portfolios, corrected for the number of tests."""
    window, every, h = _by_history(spark, d)
    old = _established(every, h)
    a = walk(spark, d, [strategy("text_inclusive"), strategy("sic_substitute", "blended")], every, window=window)[1]
    b = walk(spark, d, [strategy("text_exclusive"), strategy("lw_exclusive", "ledoit_wolf")], old, window=window)[1]
    return rounded(corrected(a.unionByName(b), [("text_inclusive", "text_exclusive"), ("text_inclusive", "lw_exclusive"), ("text_inclusive", "sic_substitute"), ("sic_substitute", "lw_exclusive")]))


_LATE = r"""numbered AS (SELECT *, CAST(regexp_extract(ticker, '(\d+)$', 1) AS INT) AS number FROM ret),
lret AS (SELECT * FROM numbered WHERE number <= 20 OR date >= CAST(DATE '1996-07-01' + INTERVAL 6 MONTH * (number - 20) AS DATE)),
hist AS (SELECT p.rebal_date, r.ticker, count(r.log_ret) AS n_ret, any_value(greatest(0, least(104, p.t_idx - 1))) AS n_days FROM lret r JOIN places p ON r.date_idx BETWEEN greatest(p.t_idx - 104, 1) AND p.t_idx - 1 GROUP BY ALL)"""


@query("young_and_established", t.sql(t.PX, t.CAL, t.RET, t.REBAL, _LATE, f"SELECT rebal_date, count_if(n_ret < {YOUNG}) AS n_young, count_if(n_ret >= {ESTABLISHED} AND n_ret >= {COMPLETE} * n_days) AS n_established, count(*) AS n_all FROM hist GROUP BY 1"))
def young_and_established(spark: SparkSession, d: str) -> DataFrame:
    """How many tickers each date splits into by their history."""
    return _by_history(spark, d)[2].groupBy("rebal_date").agg(F.count_if("is_young").alias("n_young"), F.count_if("is_established").alias("n_established"), F.count("*").alias("n_all"))


#: First days of the sub-periods after the first.
SUB_PERIODS = ("1998-04-01", "1999-04-01", "2000-07-01")


@query("temporal_sensitivity")
def temporal_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Results in four sub-periods and in all."""
    r = walk(spark, d, [SEMANTIC, LW, EW])[1]
    part = reduce(lambda a, k: F.when(F.col("date") >= F.lit(SUB_PERIODS[k]).cast("date"), str(k + 2)).otherwise(a), range(len(SUB_PERIODS)), F.lit("1"))
    p = r.withColumn("period", F.explode(F.array(part, F.lit("full")))).select(F.concat("strategy", F.lit("/"), "period").alias("strategy"), "date", "ret")
    return rounded(metrics.performance(p).select(F.substring_index("strategy", "/", 1).alias("strategy"), F.substring_index("strategy", "/", -1).alias("period"), "annualized_return", "annualized_volatility", "sharpe_ratio", "max_drawdown", "n_observations"))


@query("tfidf_experiment")
def tfidf_experiment(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of tickers' similarity by TF-IDF with that by embedded chunks, per as-of date."""
    docs = t.filings(spark, d)
    dates = spark.createDataFrame([("2016-06-30",), ("2020-01-01",)], "s string").select(F.col("s").cast("date").alias("as_of"))
    v = cut(tfidf.firm_vectors(docs, tfidf.vocabulary(docs, None, dates, max_features=200)))
    a, b = v.select("as_of", F.col("ticker").alias("a"), "term", F.col("value").alias("x")), v.select("as_of", F.col("ticker").alias("b"), "term", F.col("value").alias("y"))
    cos = a.join(b, ["as_of", "term"]).where("a < b").groupBy("as_of", "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("tfidf"))
    from ledgerline.operators.encode import embed_documents

    e = embed_documents(docs, ["ticker", "doc_id", "doc_date"], dim=64)
    other = embed.cosine_pairs(cut(embed.aggregate_universe(e, dates)))
    return rounded(cos.join(other, ["as_of", "a", "b"]).groupBy("as_of").agg(F.corr("tfidf", "cosine").alias("correlation"), F.count("*").alias("n_pairs")))


@query("tfidf_strategies")
def tfidf_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Portfolios by TF-IDF of brands' documents and by their embeddings, beside Ledoit-Wolf and equal weights: document i belongs to brand 1 + i % 25."""
    brand, day = F.concat(F.lit("Brand#"), (1 + F.col("doc_id") % 25).cast("string")), F.expr("date_add(DATE'1995-06-01', CAST(doc_id * 7 % 1800 AS INT))")
    docs = t.read(spark, d, "documents").select(brand.alias("ticker"), "doc_id", day.alias("doc_date"), "text")
    vocabulary = cut(tfidf.vocabulary(docs, None, t.rebalances(spark).withColumnRenamed("rebal_date", "as_of"), max_features=TFIDF_FEATURES))
    v = tfidf.firm_vectors(docs, vocabulary).join(vocabulary.select("as_of", "term", "place"), ["as_of", "term"])
    v = v.groupBy(F.col("as_of").alias("rebal_date"), "ticker").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))  # at most TFIDF_FEATURES of them
    dense = F.transform(F.sequence(F.lit(1), F.lit(TFIDF_FEATURES)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    neural = k.facts(spark, d)
    by_terms = neural.select("rebal_date", "ticker", "sector").join(v.select("rebal_date", "ticker", dense.alias("embedding")), ["rebal_date", "ticker"])
    names = [strategy("neural_semantic"), strategy("tfidf_semantic"), LW, EW]
    parts = [(by_terms if s["name"] == "tfidf_semantic" else neural).select(F.lit(s["name"]).alias("strategy"), "rebal_date", "ticker", "embedding", "sector") for s in names]
    return rounded(summary(*walk(spark, d, names, cut(reduce(DataFrame.unionByName, parts)))))


@query("shuffle_placebo")
def shuffle_placebo(spark: SparkSession, d: str) -> DataFrame:
    """Universe sizes: Sharpe ratio of the semantic strategy against those with embeddings shuffled among a date's members: z-score and share at least as high."""
    parts, names = [], []
    for size in PLACEBO_SIZES:
        f = k.facts(spark, d, market.members(spark, d, size))
        for seed in (None, *range(SHUFFLES)):
            names.append(f"{size}/{'real' if seed is None else seed}")
            parts.append((f if seed is None else _dealt_anew(f, seed)).select(F.lit(names[-1]).alias("strategy"), "rebal_date", "ticker", "embedding", "sector"))
    r = walk(spark, d, [strategy(n) for n in names], cut(reduce(DataFrame.unionByName, parts)))[1]
    s = metrics.performance(r).select(F.substring_index("strategy", "/", 1).cast("int").alias("size"), (F.substring_index("strategy", "/", -1) == "real").alias("is_real"), F.col("sharpe_ratio").alias("s"))
    real = s.where("is_real").select("size", F.col("s").alias("real"))
    fake = s.where("NOT is_real").groupBy("size").agg(F.count("s").alias("n_shuffles"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"), F.collect_list("s").alias("all"))
    z = F.when(F.col("sd") > 0, (F.col("real") - F.col("mean")) / F.col("sd"))
    return rounded(fake.join(F.broadcast(real), "size").select("size", "n_shuffles", "real", "mean", "sd", z.alias("z"), (F.size(F.filter("all", lambda x: x >= F.col("real"))) / F.size("all")).alias("p")))


def _dealt_anew(facts: DataFrame, seed: int) -> DataFrame:
    """facts with each date's embeddings dealt anew among its tickers."""
    e = embed.shuffled(facts.select(F.col("rebal_date").alias("as_of"), "ticker", F.lit(None).cast("int").alias("n_documents"), "embedding"), seed)
    return facts.drop("embedding").join(e.select(F.col("as_of").alias("rebal_date"), "ticker", "embedding"), ["rebal_date", "ticker"])


def _similarity_and_correlation(spark: SparkSession, d: str) -> DataFrame:
    """(rebal_date, a, b, cosine, corr): similarity as of a date, correlation of the year after it (all weeks present)."""
    pairs = embed.cosine_pairs(k.ticker_embeddings(spark, d)).withColumnRenamed("as_of", "rebal_date")
    return pairs.join(covariance.realized_corr(_forward(spark, d)), ["rebal_date", "a", "b"]).select("rebal_date", "a", "b", "cosine", "corr")


def _forward(spark: SparkSession, d: str, gap: int = 5, horizon: int = 252) -> DataFrame:
    """(rebal_date, ticker, date_idx, x) from gap days after each date for horizon trading days, tickers without a missing one."""
    dates = t.rebalances(spark)
    r = t.returns(spark, d)
    lo = F.date_add("rebal_date", gap)
    j = r.join(F.broadcast(dates), (F.col("date") >= lo) & (F.col("date") <= F.date_add("rebal_date", gap + int(horizon * 365 / 252))))
    n = j.groupBy("rebal_date").agg(F.countDistinct("date_idx").alias("n"))
    full = j.groupBy("rebal_date", "ticker").agg(F.count("log_ret").alias("c")).join(F.broadcast(n), "rebal_date").where("c = n AND n >= 30").select("rebal_date", "ticker")
    return cut(j.join(full, ["rebal_date", "ticker"], "left_semi").select("rebal_date", "ticker", "date_idx", F.col("log_ret").alias("x")))


@query("correlation_study")
def correlation_study(spark: SparkSession, d: str) -> DataFrame:
    p = _similarity_and_correlation(spark, d)
    s = inference.with_rank_p(rank.spearman(p, ["rebal_date"], "cosine", "corr"))
    verdict = F.when(F.col("rho") > 0.10, "strong").when(F.col("rho") > 0.05, "moderate").otherwise("weak")
    return rounded(s.select("rebal_date", "rho", "p_value", "n", verdict.alias("verdict")))


_FORWARD = """fj AS (SELECT r.rebal_date, x.ticker, x.date_idx, x.log_ret AS x FROM ret x JOIN rebal r ON x.date >= r.rebal_date + INTERVAL 5 DAY AND x.date <= r.rebal_date + INTERVAL 370 DAY),
fn AS (SELECT rebal_date, count(DISTINCT date_idx) AS n FROM fj GROUP BY 1), ff AS (SELECT rebal_date, ticker FROM fj JOIN fn USING (rebal_date) GROUP BY rebal_date, ticker, n HAVING count(x) = n AND n >= 30),
fr AS (SELECT a.rebal_date, a.ticker AS a, b.ticker AS b, corr(a.x, b.x) AS corr FROM (SELECT fj.* FROM fj JOIN ff USING (rebal_date, ticker)) a JOIN (SELECT fj.* FROM fj JOIN ff USING (rebal_date, ticker)) b ON a.rebal_date = b.rebal_date AND a.date_idx = b.date_idx AND a.ticker < b.ticker GROUP BY ALL),
sc AS (SELECT rebal_date, a, b, cosine, corr FROM bcos JOIN fr USING (rebal_date, a, b))"""
_STUDY = (t.PX, t.CAL, t.RET, t.REBAL, k.BRANDS, _FORWARD)


@query("correlation_study_bins", t.sql(*_STUDY, "ed AS (SELECT rebal_date, list_distinct(quantile_cont(cosine, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS e FROM sc GROUP BY 1), bn AS (SELECT s.*, greatest(len(list_filter(e, lambda v: v < cosine)) - 1, 0) AS bin FROM sc s JOIN ed USING (rebal_date))", "SELECT rebal_date, CAST(bin AS INT) AS bin, round(avg(cosine), 6) AS avg_cosine, round(avg(corr), 6) AS avg_corr, count(*) AS n_pairs FROM bn GROUP BY ALL"))
def correlation_study_bins(spark: SparkSession, d: str) -> DataFrame:
    b = rank.quantile_bins(_similarity_and_correlation(spark, d), ["rebal_date"], "cosine", 10)
    return rounded(b.groupBy("rebal_date", "bin").agg(F.avg("cosine").alias("avg_cosine"), F.avg("corr").alias("avg_corr"), F.count("*").alias("n_pairs")))


@query(
    "sector_analysis",
    t.sql(*_STUDY, t.SECTOR, "sp AS (SELECT s.rebal_date, corr AS y, cosine AS x1, CAST(coalesce(u.sector = v.sector, false) AS INT)::DOUBLE AS x2, avg(corr) OVER (PARTITION BY s.rebal_date) AS mean FROM sc s LEFT JOIN sector u ON u.ticker = s.a LEFT JOIN sector v ON v.ticker = s.b)", "SELECT rebal_date, round(corr(y, x1) ** 2, 6) AS r2_first, round(corr(y, x2) ** 2, 6) AS r2_second, round((corr(y, x1) ** 2 + corr(y, x2) ** 2 - 2 * corr(y, x1) * corr(y, x2) * corr(x1, x2)) / (1 - corr(x1, x2) ** 2), 6) AS r2_both, count_if(abs(x1 - y) < abs(mean - y)) AS wins, count(*) AS n_pairs FROM sp GROUP BY 1"),
)
def sector_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Per date: how much of realised correlation similarity and a common sector explain, and where similarity is nearer than the mean."""
    p = embed.sector_pairs(_similarity_and_correlation(spark, d), t.sectors(spark, d))
    p = p.select("rebal_date", F.col("corr").alias("y"), F.col("cosine").alias("x1"), F.col("same_sector").cast("double").alias("x2"))
    m = p.groupBy("rebal_date").agg(F.avg("y").alias("mean"))
    wins = p.join(F.broadcast(m), "rebal_date").groupBy("rebal_date").agg(F.count_if(F.abs(F.col("x1") - F.col("y")) < F.abs(F.col("mean") - F.col("y"))).alias("wins"), F.count("*").alias("n_pairs"))
    return rounded(rank.two_regressor_r2(p, ["rebal_date"]).join(wins, "rebal_date"))


def _components(spark: SparkSession, d: str, n: int = COMPONENTS) -> DataFrame:
    """(rebal_date, ticker, pc, score, share): left singular vectors of each date's embeddings."""

    def f(date, s: portfolio.Section) -> pd.DataFrame:  # noqa: ANN001
        u, v, _ = np.linalg.svd(s.e, full_matrices=False)
        return pd.concat([pd.DataFrame({"rebal_date": date, "ticker": s.tickers, "pc": c, "score": u[:, c], "share": v[c] ** 2 / (v**2).sum()}) for c in range(min(n, len(v)))])

    return cut(portfolio.per_date(k.window(spark, d), k.facts(spark, d), f, "rebal_date date, ticker string, pc int, score double, share double"))


def aligned(scores: DataFrame, least: int = 20) -> DataFrame:
    """scores with their signs made consistent from date to date: a running product of the signs of successive correlations.

    The product starts anew at a date with fewer than least tickers in common with the one before; a correlation of zero keeps the sign.
    """
    dates = scores.select("rebal_date").distinct().withColumn("q", F.row_number().over(Window.orderBy("rebal_date")))
    s = scores.join(F.broadcast(dates), "rebal_date")
    now, then = s.select("q", "pc", "ticker", F.col("score").alias("x")), s.select((F.col("q") + 1).alias("q"), "pc", "ticker", F.col("score").alias("y"))
    c = now.join(then, ["q", "pc", "ticker"]).groupBy("q", "pc").agg(F.corr("x", "y").alias("c"), F.count("*").alias("n"))
    g = s.select("q", "pc").distinct().join(c, ["q", "pc"], "left")
    w = Window.partitionBy("pc").orderBy("q")
    g = g.withColumn("run", F.sum(F.when(F.coalesce("n", F.lit(0)) < least, 1).otherwise(0)).over(w))
    sign = F.when((F.coalesce("n", F.lit(0)) >= least) & (F.col("c") < 0), -1.0).otherwise(1.0)
    g = g.withColumn("sign", F.product(sign).over(Window.partitionBy("pc", "run").orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return cut(s.join(g.select("q", "pc", "sign"), ["q", "pc"]).withColumn("score", F.col("score") * F.col("sign")).drop("sign"))


def characteristics(spark: SparkSession, d: str, lookback: int = 52) -> DataFrame:
    """(rebal_date, ticker, log_adv, vol, momentum) from the lookback weeks before each date."""
    w = k.window(spark, d, lookback)
    c = w.groupBy("rebal_date", "ticker").agg((F.stddev_samp("x") * 252**0.5).alias("vol"), (F.product(1 + F.col("x")) - 1).alias("momentum"))
    return c.join(market._adv(spark, d).select("rebal_date", "ticker", F.ln("median_adv").alias("log_adv")), ["rebal_date", "ticker"])


@query("pca_interpretation")
def pca_interpretation(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of component scores with characteristics, averaged over dates, and the mean share of variance."""
    s = aligned(_components(spark, d)).join(characteristics(spark, d), ["rebal_date", "ticker"])
    out = []
    for c in ("log_adv", "vol", "momentum"):
        r = rank.spearman(s, ["rebal_date", "pc"], "score", c).groupBy("pc").agg(F.avg("rho").alias("mean_rho"), F.count("*").alias("n_dates"))
        out.append(r.withColumn("characteristic", F.lit(c)))
    share = s.groupBy("rebal_date", "pc").agg(F.max("share").alias("share")).groupBy("pc").agg(F.avg("share").alias("mean_share"))
    return rounded(reduce(DataFrame.unionByName, out).join(share, "pc"))


@query("pca_sector_scores")
def pca_sector_scores(spark: SparkSession, d: str) -> DataFrame:
    s = aligned(_components(spark, d)).join(F.broadcast(t.sectors(spark, d)), "ticker").where("sector IS NOT NULL")
    per = s.groupBy("rebal_date", "pc", "sector").agg(F.avg("score").alias("m")).groupBy("pc", "sector").agg(F.avg("m").alias("mean_score"))
    place = F.row_number().over(Window.partitionBy("pc").orderBy(F.abs("mean_score").desc(), "sector"))
    return rounded(per.withColumn("place", place).where("place <= 5"))


@query("pca_tickers")
def pca_tickers(spark: SparkSession, d: str) -> DataFrame:
    """The ten tickers of highest and of lowest mean score on each component."""
    per = aligned(_components(spark, d)).groupBy("pc", "ticker").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n_dates"))
    high = F.row_number().over(Window.partitionBy("pc").orderBy(F.col("mean_score").desc(), "ticker"))
    low = F.row_number().over(Window.partitionBy("pc").orderBy("mean_score", "ticker"))
    per = per.withColumns({"from_top": high, "from_bottom": low})
    top = per.where("from_top <= 10").select("pc", F.lit("top").alias("side"), F.col("from_top").alias("place"), "ticker", "mean_score", "n_dates")
    return rounded(top.unionByName(per.where("from_bottom <= 10").select("pc", F.lit("bottom").alias("side"), F.col("from_bottom").alias("place"), "ticker", "mean_score", "n_dates")))


@query("pca_stability")
def pca_stability(spark: SparkSession, d: str) -> DataFrame:
    """Kendall's tau of each component's scores on successive dates."""
    s = aligned(_components(spark, d))
    now = s.select("q", "pc", F.col("ticker").alias("id"), F.col("score").alias("x"))
    then = s.select((F.col("q") + 1).alias("q"), "pc", F.col("ticker").alias("id"), F.col("score").alias("y"))
    return rounded(rank.kendall(now.join(then, ["q", "pc", "id"]), ["q", "pc"]))


def _betas(spark: SparkSession, d: str) -> DataFrame:
    """(rebal_date, ticker, text, trailing, forward): the first component's score, the beta of the last 52 weeks and that of the next 13."""
    m = market.market(spark, d).withColumnRenamed("ret", "b")
    r = panel.simple_returns(t.returns(spark, d)).join(m, "date")
    _, places = t.places(spark, d)

    def beta(lo: F.Column, hi: F.Column, name: str) -> DataFrame:
        w = places.where(hi >= lo).select("rebal_date", F.explode(F.sequence(lo, hi)).alias("date_idx"))
        return r.join(F.broadcast(w), "date_idx").groupBy("rebal_date", "ticker").agg(F.regr_slope("ret", "b").alias(name), F.count("*").alias(f"n_{name}")).where(F.col(f"n_{name}") >= 10).drop(f"n_{name}")

    i = F.col("t_idx")
    j = beta(F.greatest(i - 52, F.lit(1)), i - 1, "trailing").join(beta(i, i + 12, "forward"), ["rebal_date", "ticker"])
    return j.join(aligned(_components(spark, d, 1)).select("rebal_date", "ticker", F.col("score").alias("text")), ["rebal_date", "ticker"])


@query("beta_experiment")
def beta_experiment(spark: SparkSession, d: str) -> DataFrame:
    """Text beta (the first component) and trailing beta against the beta of the next 13 weeks, per date, with Newey-West t of the mean slopes."""
    j = cut(_betas(spark, d))
    slopes = j.groupBy("rebal_date").agg(F.regr_slope("forward", "text").alias("text"), F.regr_slope("forward", "trailing").alias("trailing"))
    long = slopes.selectExpr("rebal_date", "stack(2, 'text', text, 'trailing', trailing) AS (beta, slope)")
    r2 = rank.two_regressor_r2(j.select("rebal_date", F.col("forward").alias("y"), F.col("text").alias("x1"), F.col("trailing").alias("x2")), ["rebal_date"])
    r2 = r2.agg(F.avg("r2_first").alias("text"), F.avg("r2_second").alias("trailing"), F.avg("r2_both").alias("both")).selectExpr("stack(2, 'text', text, both, 'trailing', trailing, both) AS (beta, mean_r2, mean_r2_both)")
    return rounded(inference.newey_west(long.where("slope IS NOT NULL"), "beta", "slope", "rebal_date").join(r2, "beta"))


@query("beta_subgroups")
def beta_subgroups(spark: SparkSession, d: str) -> DataFrame:
    """How the text beta and the trailing beta predict, by the length of a ticker's history at the date."""
    h = universe.history_buckets(universe.completeness(_late_returns(spark, d), t.places(spark, d)[1], 1_000_000)).select("rebal_date", "ticker", "bucket")
    j = _betas(spark, d).join(h, ["rebal_date", "ticker"])
    miss = lambda c: F.avg(F.abs(F.col(c) - F.col("forward")))
    return rounded(j.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("n_tickers"), F.corr("text", "forward").alias("corr_text"), F.corr("trailing", "forward").alias("corr_trailing"), miss("trailing").alias("error_trailing")))


@query("var_experiment")
def var_experiment(spark: SparkSession, d: str) -> DataFrame:
    """Value-at-risk coverage of the equal-weight portfolio by covariance method and level over the 13 weeks after each date."""
    methods = ["cosine", "semantic", "sample", "ledoit_wolf"]
    cov = cut(portfolio.covariance(k.window(spark, d), k.facts(spark, d), methods))
    vol = covariance.ew_portfolio_vol(cov.select(F.concat(F.col("method"), F.lit("|"), F.col("rebal_date").cast("string")).alias("rebal_date"), "a", "b", "cov"))
    vol = vol.select(F.substring_index("rebal_date", "|", 1).alias("method"), F.substring_index("rebal_date", "|", -1).cast("date").alias("rebal_date"), "vol")
    m = market.market(spark, d).join(F.broadcast(market.periods(spark)), (F.col("date") > F.col("rebal_date")) & (F.col("date") < F.col("period_end")))
    out = []
    for a in (0.01, 0.05):
        from ledgerline.functions.stats import parametric_var

        hits = m.join(vol, "rebal_date").select("method", "date", (F.col("ret") < -parametric_var(F.col("vol"), a)).alias("hit"))
        c = inference.with_p_values(inference.coverage(inference.transitions(hits, ["method"]), a))
        out.append(c.select("method", F.lit(a).alias("alpha"), "n", "v", "lr_uc", "p_uc", "lr_cc", "p_cc"))
    return rounded(reduce(DataFrame.unionByName, out))


@query("robustness_costs")
def robustness_costs(spark: SparkSession, d: str) -> DataFrame:
    """Equal-weight results with costs of half to double."""
    w = market.equal_weights(market.members(spark, d))
    p = cut(backtest.position_days(w, t.returns(spark, d), market.periods(spark)))
    base, out = cut(market.rates(spark, d)), []
    for f in MULTIPLIERS:
        r = backtest.daily_returns(p, backtest.turnover_costs(w, backtest.drifted(p), base.withColumn("tc_rate", F.col("tc_rate") * f), 10.0 * f))
        out.append(metrics.performance(r).withColumn("factor", F.lit(f)))
    return rounded(reduce(DataFrame.unionByName, out))
