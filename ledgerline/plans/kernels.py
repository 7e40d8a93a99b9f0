"""Queries that need a matrix: covariances and optimised weights per rebalance date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import covariance, portfolio
from ledgerline.operators.embed import aggregate_universe
from ledgerline.operators.portfolio import strategy
from ledgerline.plans import market
from ledgerline.plans import tables as t
from ledgerline.plans.registry import query, rounded
from ledgerline.session import cut

LOOKBACK = 104


def ticker_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """(as_of, ticker, embedding) on the rebalance dates, for brands: vector v belongs to brand 1 + v % 25."""
    e = t.read(spark, d, "embeddings")
    docs = e.select(F.concat(F.lit("Brand#"), (1 + F.col("vec_id") % 25).cast("string")).alias("ticker"), F.expr("date_add(DATE'1995-06-01', CAST(vec_id * 7 % 1800 AS INT))").alias("doc_date"), "embedding")
    return aggregate_universe(docs, t.rebalances(spark).withColumnRenamed("rebal_date", "as_of"))


def facts(spark: SparkSession, d: str, members: DataFrame | None = None) -> DataFrame:
    """(rebal_date, ticker, embedding, sector) of a universe."""
    m = market.members(spark, d) if members is None else members
    e = ticker_embeddings(spark, d).select(F.col("as_of").alias("rebal_date"), "ticker", "embedding")
    return cut(m.select("rebal_date", "ticker").join(e, ["rebal_date", "ticker"]).join(F.broadcast(t.sectors(spark, d)), "ticker", "left"))


def window(spark: SparkSession, d: str, lookback: int = LOOKBACK) -> DataFrame:
    return cut(covariance.windowed(t.returns(spark, d), t.places(spark, d)[1], lookback))


#: The same sections for the SQL side: brands' unit mean embeddings as of each date, members with an embedding, their window.
BRANDS = """bemb AS (SELECT 'Brand#' || CAST(1 + vec_id % 25 AS VARCHAR) AS ticker, CAST(DATE '1995-06-01' + CAST(vec_id * 7 % 1800 AS INT) AS DATE) AS doc_date, embedding FROM embeddings),
bx AS (SELECT r.rebal_date, b.ticker, i, avg(CAST(b.embedding[i] AS DOUBLE)) AS v FROM bemb b JOIN rebal r ON b.doc_date <= r.rebal_date CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
bu AS (SELECT rebal_date, ticker, i, v / sqrt(sum(v * v) OVER (PARTITION BY rebal_date, ticker)) AS v FROM bx),
bcos AS (SELECT x.rebal_date, x.ticker AS a, y.ticker AS b, greatest(least(sum(x.v * y.v), 1), -1) AS cosine FROM bu x JOIN bu y ON x.rebal_date = y.rebal_date AND x.i = y.i AND x.ticker <= y.ticker GROUP BY ALL)"""
_SECTION = f"""fx AS (SELECT u.rebal_date, u.ticker, s.sector FROM universe u JOIN (SELECT DISTINCT rebal_date, ticker FROM bx) e USING (rebal_date, ticker) LEFT JOIN sector s ON s.ticker = u.ticker),
fw AS (SELECT f.rebal_date, f.ticker, r.date_idx, r.log_ret AS x FROM ret r JOIN places p ON r.date_idx BETWEEN greatest(p.t_idx - {LOOKBACK}, 1) AND p.t_idx - 1 JOIN fx f ON f.rebal_date = p.rebal_date AND f.ticker = r.ticker),
fn AS (SELECT rebal_date, n, p FROM (SELECT rebal_date, count(DISTINCT date_idx) AS n FROM fw GROUP BY 1) JOIN (SELECT rebal_date, count(*) AS p FROM fx GROUP BY 1) USING (rebal_date) WHERE n >= 10 AND p >= 2),
fs AS (SELECT f.rebal_date, f.ticker, f.sector, n, p, coalesce(sum(x), 0) / any_value(n) AS m FROM fx f JOIN fn USING (rebal_date) LEFT JOIN fw w ON w.rebal_date = f.rebal_date AND w.ticker = f.ticker GROUP BY f.rebal_date, f.ticker, f.sector, n, p),
fxy AS (SELECT a.rebal_date, a.ticker AS a, b.ticker AS b, sum(a.x * b.x) AS xy FROM fw a JOIN fw b ON a.rebal_date = b.rebal_date AND a.date_idx = b.date_idx AND a.ticker <= b.ticker GROUP BY ALL),
fg AS (SELECT u.rebal_date, u.ticker AS a, v.ticker AS b, u.sector AS sa, v.sector AS sb, u.n, u.p, coalesce(xy, 0) - u.n * u.m * v.m AS g FROM fs u JOIN fs v ON u.rebal_date = v.rebal_date AND u.ticker <= v.ticker LEFT JOIN fxy ON fxy.rebal_date = u.rebal_date AND fxy.a = u.ticker AND fxy.b = v.ticker),
fd AS (SELECT rebal_date, a AS ticker, sqrt(g / (n - 1)) AS sigma FROM fg WHERE a = b)"""
_SHRUNK = """fe AS (SELECT d.rebal_date, d.date_idx, sum((coalesce(w.x, 0) - s.m) ** 2) AS e FROM (SELECT DISTINCT rebal_date, date_idx FROM fw) d JOIN fs s USING (rebal_date) LEFT JOIN fw w ON w.rebal_date = d.rebal_date AND w.date_idx = d.date_idx AND w.ticker = s.ticker GROUP BY ALL),
fk AS (SELECT rebal_date, avg(e * e) AS e2, avg(e) AS e1 FROM fe GROUP BY 1), fl AS (SELECT rebal_date, n, p, sum(CASE WHEN a = b THEN 1 ELSE 2 END * g * g) / any_value(n * n) AS norm2 FROM fg GROUP BY rebal_date, n, p),
fi AS (SELECT rebal_date, e1 / p AS level, norm2 - e1 * e1 / p AS distance, (e2 - norm2) / n AS scatter FROM fk JOIN fl USING (rebal_date))"""
_OF_PAIR = "JOIN fd u ON u.rebal_date = fg.rebal_date AND u.ticker = fg.a JOIN fd v ON v.rebal_date = fg.rebal_date AND v.ticker = fg.b"
#: What SQL can say where no eigenvalue has to be raised; the tables' matrices are of full rank.
COVARIANCE_SQL = {
    "psd_cov": "SELECT rebal_date, 'sample' AS method, a, b, round(g / (n - 1), 8) AS cov FROM fg",
    "lw_cov": "SELECT rebal_date, 'ledoit_wolf' AS method, a, b, round((1 - least(scatter, distance) / distance) * g / n + CASE WHEN a = b THEN least(scatter, distance) / distance * level ELSE 0 END, 8) AS cov FROM fg JOIN fi USING (rebal_date)",
    "text_cov_pairs": f"SELECT fg.rebal_date, 'cosine' AS method, fg.a, fg.b, round(cosine * u.sigma * v.sigma, 8) AS cov FROM fg {_OF_PAIR} JOIN bcos c ON c.rebal_date = fg.rebal_date AND c.a = fg.a AND c.b = fg.b",
    "sector_cov": f"SELECT fg.rebal_date, 'sector' AS method, fg.a, fg.b, round(CASE WHEN fg.a = fg.b THEN 1 WHEN sa = sb THEN 0.5 ELSE 0.2 END::DOUBLE * u.sigma * v.sigma, 8) AS cov FROM fg {_OF_PAIR}",
    "semantic_shrinkage_cov": f"SELECT fg.rebal_date, 'semantic' AS method, fg.a, fg.b, round((1 - least(scatter, distance) / distance) * g / (n - 1) + least(scatter, distance) / distance * cosine * u.sigma * v.sigma, 8) AS cov FROM fg JOIN fi ON fi.rebal_date = fg.rebal_date {_OF_PAIR} JOIN bcos c ON c.rebal_date = fg.rebal_date AND c.a = fg.a AND c.b = fg.b",
    "blended_cov": "SELECT fg.rebal_date, 'blended' AS method, fg.a, fg.b, round(CASE WHEN u.old AND v.old AND o.n_old > 1 THEN g / (n - 1) ELSE CASE WHEN fg.a = fg.b THEN 1 WHEN sa = sb THEN 0.5 ELSE 0.2 END::DOUBLE * u.sd * v.sd END, 8) AS cov FROM fg JOIN fh u ON u.rebal_date = fg.rebal_date AND u.ticker = fg.a JOIN fh v ON v.rebal_date = fg.rebal_date AND v.ticker = fg.b JOIN (SELECT rebal_date, count_if(old) AS n_old FROM fh GROUP BY 1) o ON o.rebal_date = fg.rebal_date",
}
_HISTORY = "fh AS (SELECT f.rebal_date, f.ticker, coalesce(stddev_samp(x), 0) AS sd, count(x) >= 0.9 * any_value(n) AS old FROM fs f LEFT JOIN fw w ON w.rebal_date = f.rebal_date AND w.ticker = f.ticker GROUP BY f.rebal_date, f.ticker)"
COVARIANCE_SQL = {n: t.sql(*t.BASE, t.SECTOR, BRANDS, _SECTION, *([_SHRUNK] if n in ("lw_cov", "semantic_shrinkage_cov") else []), *([_HISTORY] if n == "blended_cov" else []), x) for n, x in COVARIANCE_SQL.items()}

for _name, _methods in {
    "psd_cov": ["sample"], "lw_cov": ["ledoit_wolf"], "text_cov_pairs": ["cosine"], "semantic_shrinkage_cov": ["semantic"], "cv_alpha": ["semantic_cv"], "pca_factor_cov": ["pca"],
    "multitarget_cov": ["multi_target_cv", "multi_target_frobenius"], "sector_cov": ["sector"], "blended_cov": ["blended"],
}.items():

    @query(_name, COVARIANCE_SQL.get(_name))
    def cov(spark: SparkSession, d: str, methods: list[str] = _methods) -> DataFrame:
        return rounded(portfolio.covariance(window(spark, d), facts(spark, d), methods), 8)


#: Sectors of equal weights above 0.30 are cut, and what they lose goes to the members of the others, ten times at most.
_CAPPED = """st AS (SELECT rebal_date, coalesce(sector, '_unknown') AS sec, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) / any_value(p) AS w, 0 AS k FROM fs GROUP BY ALL
  UNION ALL SELECT rebal_date, sec, n, CASE WHEN w > 0.3 + 1e-10 THEN 0.3 WHEN free = 0 THEN w ELSE w + excess * n / free END, k + 1
  FROM (SELECT *, sum(CASE WHEN w > 0.3 + 1e-10 THEN w - 0.3 ELSE 0 END) OVER (PARTITION BY rebal_date) AS excess, sum(CASE WHEN w > 0.3 + 1e-10 THEN 0 ELSE n END) OVER (PARTITION BY rebal_date) AS free FROM st) WHERE k < 10),
last AS (SELECT rebal_date, sec, w / n / sum(w) OVER (PARTITION BY rebal_date) AS w FROM st WHERE k = 10)"""
WEIGHT_SQL = {
    "sector_capped_equal_weights": t.sql(*t.BASE, t.SECTOR, BRANDS, _SECTION, _CAPPED, "SELECT 'ew_sector_30' AS strategy, fs.rebal_date, fs.ticker, round(l.w, 6) AS weight FROM fs JOIN last l ON l.rebal_date = fs.rebal_date AND l.sec = coalesce(fs.sector, '_unknown')").replace("WITH ", "WITH RECURSIVE ", 1),
}

for _name, _strategies in {
    "min_variance_weights": [strategy("lw", "ledoit_wolf"), strategy("semantic")],
    "max_sharpe_weights": [strategy("max_sharpe", objective="max_sharpe")],
    "mean_variance_weights": [strategy("mean_variance", objective="mean_variance")],
    "risk_parity_weights": [strategy("risk_parity", objective="risk_parity")],
    "sector_constrained_weights": [strategy("sector_25", sector_cap=0.25, cap=0.2)],
    "sector_capped_equal_weights": [strategy("ew_sector_30", "equal", sector_cap=0.30)],
    "vol_target_weights": [strategy("vol_10", vol_target=0.10)],
    "sic_portfolio_weights": [strategy("sic", "sector")],
}.items():

    @query(_name, WEIGHT_SQL.get(_name))
    def weights(spark: SparkSession, d: str, strategies: list[dict] = _strategies) -> DataFrame:
        return rounded(portfolio.weights(window(spark, d), facts(spark, d), strategies))
