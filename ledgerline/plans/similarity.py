"""Queries over embeddings and covariance pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import covariance, embed, rank
from ledgerline.plans import tables as t
from ledgerline.plans.registry import query, rounded

LOOKBACK = 52


@query("doc_norms", t.sql(t.EMB, "SELECT ticker, doc_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x * x))), 5) AS norm FROM emb"))
def doc_norms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(embed.document_norms(t.embeddings(spark, d)).select("ticker", "doc_id", "norm"), 5)


_FIRM = """dw AS (SELECT a.as_of, e.ticker, {w} AS w, unnest(e.embedding) AS x, generate_subscripts(e.embedding, 1) AS k FROM emb e JOIN asofd a ON e.doc_date <= a.as_of),
dm AS (SELECT as_of, ticker, k, sum(w * x) / sum(w) AS v, count(*) AS n FROM dw GROUP BY ALL), nn AS (SELECT as_of, ticker, max(n) AS n_documents, sqrt(sum(v * v)) AS nrm FROM dm GROUP BY ALL),
firm AS (SELECT as_of, ticker, k, v / nrm AS u, n_documents FROM dm JOIN nn USING (as_of, ticker))"""
_DECAY = "exp(-ln(2.0) * (a.as_of - e.doc_date) / 365)"
for _name, _mode, _w in (("firm_embedding_mean", "mean", "1.0::DOUBLE"), ("firm_embedding_decay", "time_weighted", _DECAY)):

    @query(_name, t.sql(t.EMB, t.ASOF, _FIRM.replace("{w}", _w), "SELECT as_of, ticker, n_documents, CAST(k - 1 AS INT) AS k, round(u, 5) AS v FROM firm"))
    def firm_embedding(spark: SparkSession, d: str, mode: str = _mode) -> DataFrame:
        e = embed.aggregate_universe(t.embeddings(spark, d), t.as_of_dates(spark), mode)
        return rounded(e.select("as_of", "ticker", "n_documents", F.posexplode("embedding").alias("k", "v")), 5)


@query("firm_doc_counts", t.sql(t.EMB, t.ASOF, "SELECT as_of, ticker, count(*) AS n_documents FROM emb JOIN asofd ON doc_date <= as_of GROUP BY ALL HAVING count(*) >= 5"))
def firm_doc_counts(spark: SparkSession, d: str) -> DataFrame:
    return embed.aggregate_universe(t.embeddings(spark, d), t.as_of_dates(spark), min_documents=5).select("as_of", "ticker", "n_documents")


def firms(spark: SparkSession, d: str) -> DataFrame:
    return embed.aggregate_universe(t.embeddings(spark, d), t.as_of_dates(spark))


_COS = (t.EMB, t.ASOF, _FIRM.replace("{w}", "1.0::DOUBLE"), "cosine AS (SELECT x.as_of, x.ticker AS a, y.ticker AS b, greatest(least(sum(x.u * y.u), 1), -1) AS cosine FROM firm x JOIN firm y ON x.as_of = y.as_of AND x.k = y.k AND x.ticker < y.ticker GROUP BY ALL)")


@query("cosine_pairs", t.sql(*_COS, "SELECT as_of, a, b, round(cosine, 5) AS cosine FROM cosine"))
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(embed.cosine_pairs(firms(spark, d)), 5)


_TSEC = "ts AS (SELECT DISTINCT ticker, CASE WHEN ticker NOT IN ('T8', 'T9') THEN CAST(CAST(substr(ticker, 2) AS INT) % 3 AS VARCHAR) END AS sector FROM emb)"
_MATCH = "matched AS (SELECT c.*, coalesce(x.sector = y.sector, false) AS same_sector FROM cosine c LEFT JOIN ts x ON x.ticker = c.a LEFT JOIN ts y ON y.ticker = c.b)"


def embedding_sectors(spark: SparkSession, d: str) -> DataFrame:
    x = t.embeddings(spark, d).select("ticker").distinct()
    return x.select("ticker", F.when(~F.col("ticker").isin("T8", "T9"), (F.substring("ticker", 2, 9).cast("int") % 3).cast("string")).alias("sector"))


@query("sector_match_pairs", t.sql(*_COS, _TSEC, _MATCH, "SELECT as_of, a, b, round(cosine, 5) AS cosine, same_sector FROM matched"))
def sector_match_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(embed.sector_pairs(embed.cosine_pairs(firms(spark, d)), embedding_sectors(spark, d)), 5)


@query("disagreement_pairs", t.sql(*_COS, _TSEC, _MATCH, "(SELECT as_of, a, b, round(cosine, 5) AS cosine, same_sector FROM matched WHERE same_sector ORDER BY round(cosine, 9), a, b, as_of LIMIT 20) UNION ALL (SELECT as_of, a, b, round(cosine, 5) AS cosine, same_sector FROM matched WHERE NOT same_sector ORDER BY round(cosine, 9) DESC, a, b, as_of LIMIT 20)"))
def disagreement_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = embed.sector_pairs(rounded(embed.cosine_pairs(firms(spark, d)), 9), embedding_sectors(spark, d))
    return rounded(embed.disagreements(p), 5)


def window(spark: SparkSession, d: str) -> DataFrame:
    return t.once(("window", d, LOOKBACK), lambda: covariance.windowed(t.returns(spark, d), t.places(spark, d)[1], LOOKBACK))


_WIN = f"""win AS (SELECT p.rebal_date, r.ticker, r.date_idx, r.log_ret AS x FROM ret r JOIN places p ON r.date_idx BETWEEN greatest(p.t_idx - {LOOKBACK}, 1) AND p.t_idx - 1),
nd AS (SELECT rebal_date, count(DISTINCT date_idx) AS n, count(DISTINCT ticker) AS p FROM win GROUP BY 1)"""
_COV = """sx AS (SELECT rebal_date, ticker, sum(x) AS s FROM win GROUP BY ALL), xy AS (SELECT a.rebal_date, a.ticker AS a, b.ticker AS b, sum(a.x * b.x) AS xy FROM win a JOIN win b ON a.rebal_date = b.rebal_date AND a.date_idx = b.date_idx AND a.ticker <= b.ticker GROUP BY ALL),
cov AS (SELECT xy.rebal_date, xy.a, xy.b, nd.n, (xy - u.s * v.s / nd.n) / (nd.n - 1) AS cov FROM xy JOIN nd USING (rebal_date) JOIN sx u ON u.rebal_date = xy.rebal_date AND u.ticker = xy.a JOIN sx v ON v.rebal_date = xy.rebal_date AND v.ticker = xy.b)"""
_BASE = (t.PX, t.CAL, t.RET, t.REBAL, _WIN)


@query("sample_cov_pairs", t.sql(*_BASE, _COV, "SELECT rebal_date, a, b, n, round(cov, 8) AS cov FROM cov"))
def sample_cov_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(covariance.sample_cov(window(spark, d)), 8)


@query("realized_corr_pairs", t.sql(*_BASE, "SELECT a.rebal_date, a.ticker AS a, b.ticker AS b, round(corr(a.x, b.x), 6) AS corr, count(*) AS n FROM win a JOIN win b ON a.rebal_date = b.rebal_date AND a.date_idx = b.date_idx AND a.ticker < b.ticker GROUP BY ALL"))
def realized_corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(covariance.realized_corr(window(spark, d)))


_LW = """mu AS (SELECT s.rebal_date, s.ticker, s.s / nd.n AS m FROM sx s JOIN nd USING (rebal_date)), gd AS (SELECT DISTINCT rebal_date, date_idx FROM win),
cx AS (SELECT g.rebal_date, g.date_idx, m.ticker, coalesce(w.x, 0) - m.m AS c FROM gd g JOIN mu m USING (rebal_date) LEFT JOIN win w USING (rebal_date, date_idx, ticker)),
bq AS (SELECT rebal_date, sum(q * q) AS beta_, sum(q) AS tr FROM (SELECT rebal_date, date_idx, sum(c * c) AS q FROM cx GROUP BY ALL) GROUP BY 1),
gr AS (SELECT rebal_date, sum(g * g) AS g2 FROM (SELECT x.rebal_date, x.ticker AS a, y.ticker AS b, sum(x.c * y.c) AS g FROM cx x JOIN cx y USING (rebal_date, date_idx) GROUP BY ALL) GROUP BY 1),
lw AS (SELECT rebal_date, n, p, tr / n AS trace, tr / n / p AS mu, g2 / (n * n) AS delta_, beta_ FROM nd JOIN bq USING (rebal_date) JOIN gr USING (rebal_date)),
lw2 AS (SELECT rebal_date, (beta_ / n - delta_) / (p * n) AS beta, (delta_ - 2 * mu * trace + p * mu * mu) / p AS delta FROM lw)"""


@query("lw_shrinkage_coef", t.sql(*_BASE, _COV, _LW, "SELECT rebal_date, round(least(beta, delta) / delta, 6) AS shrinkage FROM lw2"))
def lw_shrinkage_coef(spark: SparkSession, d: str) -> DataFrame:
    return rounded(covariance.lw_shrinkage(window(spark, d)))


_SIC = """sg AS (SELECT rebal_date, ticker, stddev_samp(x) AS sigma FROM win GROUP BY ALL), sc AS (SELECT sg.*, coalesce(sector, '_unknown_' || ticker) AS sec FROM sg LEFT JOIN sector USING (ticker)),
sic AS (SELECT x.rebal_date, x.ticker AS a, y.ticker AS b, CASE WHEN x.ticker = y.ticker THEN 1.0 WHEN x.sec = y.sec THEN 0.5 ELSE 0.2 END::DOUBLE * x.sigma * y.sigma AS cov FROM sc x JOIN sc y ON x.rebal_date = y.rebal_date AND x.ticker <= y.ticker)"""


@query("sic_cov_pairs", t.sql(*_BASE, t.SECTOR, _SIC, "SELECT rebal_date, a, b, round(cov, 8) AS cov FROM sic"))
def sic_cov_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(covariance.sector_cov(covariance.sigmas(window(spark, d)), t.sectors(spark, d)), 8)


@query("ew_portfolio_vol", t.sql(*_BASE, _COV, "SELECT rebal_date, round(sqrt(greatest(sum(CASE WHEN a = b THEN cov ELSE 2 * cov END) / count_if(a = b) ** 2, 0)), 8) AS vol FROM cov GROUP BY 1"))
def ew_portfolio_vol(spark: SparkSession, d: str) -> DataFrame:
    return rounded(covariance.ew_portfolio_vol(covariance.sample_cov(window(spark, d))), 8)


_FROB = """idt AS (SELECT rebal_date, a, b, CASE WHEN a = b THEN cov ELSE 0 END AS cov FROM cov),
fs AS (SELECT c.rebal_date, CASE WHEN c.a = c.b THEN 1 ELSE 2 END AS k, c.cov AS s, s.cov AS sic, i.cov AS idt FROM cov c JOIN sic s USING (rebal_date, a, b) JOIN idt i USING (rebal_date, a, b))"""


@query("frobenius_products", t.sql(*_BASE, _COV, t.SECTOR, _SIC, _FROB, "SELECT rebal_date, round(sum(k * (sic - s) * (sic - s)), 8) AS sic_sic, round(sum(k * (sic - s) * (idt - s)), 8) AS sic_identity, round(sum(k * (idt - s) * (idt - s)), 8) AS identity_identity, round(sum(k * (sic - s) * s), 8) AS sic_s, round(sum(k * (idt - s) * s), 8) AS identity_s FROM fs GROUP BY 1"))
def frobenius_products(spark: SparkSession, d: str) -> DataFrame:
    w = window(spark, d)
    cov = covariance.sample_cov(w)
    identity = cov.withColumn("cov", F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise(0.0))
    return rounded(covariance.frobenius_products(cov, {"sic": covariance.sector_cov(covariance.sigmas(w), t.sectors(spark, d)), "identity": identity}), 8)


_PAIRS = """pr AS (SELECT a.rebal_date, a.ticker AS a, b.ticker AS b, corr(a.x, b.x) AS x FROM win a JOIN win b ON a.rebal_date = b.rebal_date AND a.date_idx = b.date_idx AND a.ticker < b.ticker GROUP BY ALL),
pp AS (SELECT p.rebal_date, p.a, p.b, round(p.x, 9) AS x, round(s.cov / sqrt(u.cov * v.cov), 9) + round(p.x, 3) AS y FROM pr p JOIN sic s USING (rebal_date, a, b) JOIN sic u ON u.rebal_date = p.rebal_date AND u.a = p.a AND u.b = p.a JOIN sic v ON v.rebal_date = p.rebal_date AND v.a = p.b AND v.b = p.b)"""


def correlation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(rebal_date, a, b, x, y): realised correlation and a sector-based guess that has ties."""
    w = window(spark, d)
    real = covariance.realized_corr(w).select("rebal_date", "a", "b", F.round("corr", 9).alias("x"), F.round("corr", 3).alias("x3"))
    sic = covariance.sector_cov(covariance.sigmas(w).withColumn("sigma", F.lit(1.0)), t.sectors(spark, d))
    return real.join(sic, ["rebal_date", "a", "b"]).select("rebal_date", "a", "b", "x", (F.round("cov", 9) + F.col("x3")).alias("y"))


@query("spearman", t.sql(*_BASE, t.SECTOR, _SIC, _PAIRS, "rk AS (SELECT rebal_date, rank() OVER (PARTITION BY rebal_date ORDER BY x) + (count(*) OVER (PARTITION BY rebal_date, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY rebal_date ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY rebal_date, round(y, 9)) - 1) / 2.0 AS ry FROM pp)", "SELECT rebal_date, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM rk GROUP BY 1"))
def spearman(spark: SparkSession, d: str) -> DataFrame:
    p = correlation_pairs(spark, d).withColumn("y", F.round("y", 9))
    return rounded(rank.spearman(p, ["rebal_date"]).select("rebal_date", "rho", "n"))


@query("kendall_tau_pairs", t.sql(*_BASE, t.SECTOR, _SIC, _PAIRS, "k AS (SELECT rebal_date, a || '|' || b AS id, x, round(y, 9) AS y FROM pp)", "s AS (SELECT p.rebal_date, sign(p.x - q.x) AS sx, sign(p.y - q.y) AS sy FROM k p JOIN k q ON p.rebal_date = q.rebal_date AND p.id < q.id)", "SELECT rebal_date, round(sum(sx * sy) / sqrt(sum(sx * sx) * sum(sy * sy)), 6) AS tau FROM s GROUP BY 1"))
def kendall_tau_pairs(spark: SparkSession, d: str) -> DataFrame:
    """tau over all pairs of a date."""
    p = correlation_pairs(spark, d).select("rebal_date", F.concat_ws("|", "a", "b").alias("id"), "x", F.round("y", 9).alias("y"))
    return rounded(rank.kendall(p, ["rebal_date"]))


@query("qcut_deciles", t.sql(*_BASE, t.SECTOR, _SIC, _PAIRS, "ed AS (SELECT rebal_date, list_distinct(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS e FROM pp GROUP BY 1)", "bn AS (SELECT p.*, greatest(len(list_filter(e, lambda v: v < x)) - 1, 0) AS bin FROM pp p JOIN ed USING (rebal_date))", "SELECT rebal_date, CAST(bin AS INT) AS bin, round(avg(x), 6) AS avg_x, round(avg(y), 6) AS avg_y, count(*) AS n FROM bn GROUP BY ALL"))
def qcut_deciles(spark: SparkSession, d: str) -> DataFrame:
    b = rank.quantile_bins(correlation_pairs(spark, d), ["rebal_date"], "x", 10)
    return rounded(b.groupBy("rebal_date", "bin").agg(F.avg("x").alias("avg_x"), F.avg("y").alias("avg_y"), F.count("*").alias("n")))


@query("ols_r2", t.sql(*_BASE, t.SECTOR, _SIC, _PAIRS, "zz AS (SELECT rebal_date, x AS y, y AS x1, ascii(substr(a, 7, 1)) AS x2 FROM pp)", "SELECT rebal_date, round(regr_r2(y, x1), 6) AS r2_first, round(regr_r2(y, x2), 6) AS r2_second, round((corr(y, x1) ** 2 + corr(y, x2) ** 2 - 2 * corr(y, x1) * corr(y, x2) * corr(x1, x2)) / (1 - corr(x1, x2) ** 2), 6) AS r2_both FROM zz GROUP BY 1"))
def ols_r2(spark: SparkSession, d: str) -> DataFrame:
    p = correlation_pairs(spark, d).select("rebal_date", F.col("x").alias("y"), F.col("y").alias("x1"), F.ascii(F.substring("a", 7, 1)).alias("x2"))
    return rounded(rank.two_regressor_r2(p, ["rebal_date"]))
