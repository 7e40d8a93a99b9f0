"""Scans and sinks of the research tables. Every scan has an explicit schema and checks what it needs."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.functions.vectors import norm
from ledgerline.operators import panel

#: Fixed value: document kinds by the name of a selection.
SOURCES = {"10k": ["10-K"], "transcript": ["transcript"], "news": ["news"], "combined": ["10-K", "transcript"], "all": ["10-K", "transcript", "news"]}
MOST_CHARS = 500_000


def read_prices(spark: SparkSession, path: str, least_rows: int = 100) -> DataFrame:
    """(ticker, date, open, ..., volume) partitioned by ticker; tickers of least_rows rows or fewer don't count; NaN is null."""
    p = schemas.nan_to_null(schemas.validate(spark.read.parquet(path), ["ticker", "date", "close", "volume"], "price table"))
    enough = p.groupBy("ticker").count().where(F.col("count") > least_rows).select("ticker")
    return p.join(enough, "ticker", "left_semi")


def write_prices(prices: DataFrame, path: str, least_rows: int = 100) -> None:
    enough = prices.groupBy("ticker").count().where(F.col("count") > least_rows).select("ticker")
    prices.join(enough, "ticker", "left_semi").write.mode("overwrite").partitionBy("ticker").parquet(path)


def load_price_data(spark: SparkSession, path: str, start: str = "2000-01-01", end: str = "2025-12-31") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prices, log returns, dollar volumes), all lazy; the date filter reaches the scan."""
    p = read_prices(spark, path).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return p, panel.log_returns(p), panel.dollar_volume(p)


def extend_prices(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, new rows in place of old ones of the same ticker and date."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rn = F.row_number().over(Window.partitionBy("ticker", "date").orderBy(F.col("_new").desc()))
    return both.withColumn("_rn", rn).where("_rn = 1").drop("_rn", "_new")


def api_rows(ticker: str, payload: list[dict]) -> list[tuple]:
    """Rows of a price service's answer: adjusted fields under the plain names, rows without any value left out."""
    out = []
    for r in payload:
        v = [r.get(k) for k in ("adjOpen", "adjHigh", "adjLow", "adjClose", "adjVolume")]
        if any(x is not None for x in v):
            out.append((ticker, r["date"][:10], *v))
    return sorted(out)


def fetch_prices(spark: SparkSession, tickers: DataFrame, fetch: Callable[[str], list[dict] | None], partitions: int = 1) -> DataFrame:
    """Prices of tickers by a caller-supplied fetch (None: unknown ticker), a ticker at a time; few partitions respect a rate limit."""

    def run(batches: Iterable) -> Iterable:
        import pandas as pd

        for b in batches:
            rows = [r for t in b["ticker"] for r in api_rows(t, fetch(t) or [])]
            yield pd.DataFrame(rows, columns=["ticker", "date", "open", "high", "low", "close", "volume"])

    raw = tickers.select("ticker").repartition(partitions).mapInPandas(run, "ticker string, date string, open double, high double, low double, close double, volume double")
    return raw.withColumn("date", F.to_date("date"))


def read_cik(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik, name) of a JSON object by ticker; tickers in upper case, numbers of ten digits."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<cik string, name string>>")).alias("t", "v"))
    return m.select(F.upper("t").alias("ticker"), F.lpad("v.cik", 10, "0").alias("cik"), F.col("v.name").alias("name"))


def read_sic(spark: SparkSession, path: str, digits: int | None = 2) -> DataFrame:
    """(ticker, sic); codes shorter than two digits are left out, longer ones cut to digits."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<sic string, sic_description string, cik string, name string>>")).alias("ticker", "v"))
    m = m.where(F.length("v.sic") >= 2)
    return m.select("ticker", (F.substring("v.sic", 1, digits) if digits else F.col("v.sic")).alias("sic"))


def read_filing_dates(spark: SparkSession, path: str) -> DataFrame:
    """(cik, year, filed_date) of a JSON object whose keys are cik|year."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("k", "v"))
    part = F.split("k", r"\|")
    return m.select(part[0].alias("cik"), part[1].cast("int").alias("year"), F.to_date("v").alias("filed_date"))


def filing_dates(submissions: DataFrame) -> DataFrame:
    """(cik, year, filed_date) from rows (cik, ord, form, filing_date, report_date): the last plain 10-K of a year, or else its first variant."""
    s = submissions.where(F.col("form").isin("10-K", "10-K/A", "10-KSB", "10-KSB/A") & F.col("report_date").isNotNull()).withColumn("year", F.substring("report_date", 1, 4).cast("int"))
    plain = F.max_by("filing_date", F.when(F.col("form") == "10-K", F.col("ord")))
    return s.groupBy("cik", "year").agg(F.coalesce(plain, F.min_by("filing_date", "ord")).alias("filed_date"))


def read_factor_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(date, names) of a percent table inside a text file: from the first line that starts with eight digits to the first that doesn't."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("i"))  # one small file: one partition, in order
    data = F.col("value").rlike(r"^\s*\d{8}\s*,")
    first = lines.where(data).agg(F.min("i").alias("a"))
    stop = lines.join(F.broadcast(first)).where((F.col("i") > F.col("a")) & ~data).agg(F.min("i").alias("b"))
    rows = lines.join(F.broadcast(first)).join(F.broadcast(stop)).where(data & (F.col("i") >= F.col("a")) & (F.col("b").isNull() | (F.col("i") < F.col("b"))))
    part = F.split("value", ",")
    return rows.select(F.to_date(F.trim(part[0]), "yyyyMMdd").alias("date"), *[(F.trim(part[k + 1]).try_cast("double") / 100).alias(n) for k, n in enumerate(names)])


def join_factors(five: DataFrame, momentum: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Dates that both have, within [start, end]; the momentum column is the one whose name begins with mom."""
    name = next((c for c in momentum.columns if c.lower().startswith("mom")), next(c for c in momentum.columns if c != "date"))
    j = five.join(momentum.select("date", F.col(name).alias("Mom")), "date")
    return j.where((F.col("date") >= F.lit(start).cast("date")) if start else F.lit(True)).where((F.col("date") <= F.lit(end).cast("date")) if end else F.lit(True))


def filing_corpus(raw: DataFrame, ciks: DataFrame) -> DataFrame:
    """(ticker, cik, year, text, word_count, char_count) of (cik, year, text, ord) rows: years from 2000, 500 characters at least, the last row of a (ticker, year) stays."""
    stripped = lambda c: F.trim(F.regexp_replace(c, "^0+", ""))
    one = ciks.groupBy(stripped(F.col("cik")).alias("k")).agg(F.max("ticker").alias("ticker"), F.max("cik").alias("cik"))
    r = raw.where(F.col("year").rlike(r"^\d+$")).withColumn("year", F.col("year").cast("int")).where((F.col("year") >= 2000) & (F.length("text") >= 500)).withColumn("k", stripped(F.col("cik"))).drop("cik")
    r = r.join(one, "k").groupBy("ticker", "year").agg(F.max_by(F.struct("cik", "text"), "ord").alias("x"))
    text = F.left("x.text", F.lit(MOST_CHARS))
    return r.select("ticker", F.col("x.cik").alias("cik"), "year", text.alias("text"), F.regexp_count("x.text", F.lit(r"(?U)\S+")).cast("long").alias("word_count"), F.length("x.text").cast("long").alias("char_count"))


def transcript_corpus(raw: DataFrame, tickers: DataFrame) -> DataFrame:
    """(ticker, year, quarter, date, text, char_count) of known tickers' transcripts of 100 characters at least."""
    r = raw.withColumn("ticker", F.upper("symbol")).join(tickers.select("ticker").distinct(), "ticker", "left_semi").where(F.length("text") >= 100)
    return r.select("ticker", F.coalesce(F.col("year").cast("int"), F.lit(0)).alias("year"), F.coalesce(F.col("quarter").cast("int"), F.lit(0)).alias("quarter"), F.left("date", F.lit(10)).alias("date"), F.left("text", F.lit(MOST_CHARS)).alias("text"), F.length("text").cast("long").alias("char_count"))


def read_texts(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """One row a file: its groups of pattern (over the path) by names, and text."""
    f = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("p"))
    return f.select(*[F.regexp_extract("p", pattern, k + 1).alias(n) for k, n in enumerate(names)], F.col("value").alias("text"))


def latest_file(spark: SparkSession, path: str) -> Column | str | None:
    """The greatest name among a folder's Parquet files."""
    return spark.read.parquet(path).agg(F.max(F.col("_metadata.file_path")).alias("p")).first()["p"]


def read_embeddings(spark: SparkSession, path: str, kinds: str = "10k") -> DataFrame:
    """Document embeddings of a source, norm and n_chunks filled in where missing; unknown source: ValueError."""
    if kinds not in SOURCES:
        raise ValueError(f"unknown text source: {kinds}")
    e = schemas.validate(spark.read.parquet(path), ["ticker", "doc_date", "doc_type", "embedding"], "embedding store")
    for c, t in (("norm", "double"), ("n_chunks", "int")):
        e = e if c in e.columns else e.withColumn(c, F.lit(None).cast(t))
    e = e.where(F.col("doc_type").isin(*SOURCES[kinds]))
    return e.select("ticker", "doc_date", "doc_type", "embedding", F.coalesce("norm", norm(F.col("embedding"))).alias("norm"), F.coalesce("n_chunks", F.lit(1)).alias("n_chunks"))


def write_embeddings(e: DataFrame, path: str, mode: str = "append") -> None:
    schemas.validate(e, ["ticker", "doc_date", "doc_type", "embedding", "norm", "n_chunks"], "embedding store").write.mode(mode).parquet(path)


def tickers_with_embeddings(e: DataFrame) -> DataFrame:
    return e.where(F.size("embedding") > 0).select("ticker").distinct()


def union_sources(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def write_result(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under its name, for a later study to read."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def benchmark_returns(returns: DataFrame, ticker: str) -> DataFrame:
    """(date, ret): the log returns of one ticker, which serve as the benchmark's."""
    return returns.where(F.col("ticker") == ticker).select("date", F.col("log_ret").alias("ret"))


def write_json_cache(rows: DataFrame, path: str) -> None:
    """A cache of small records as JSON lines."""
    rows.write.mode("overwrite").json(path)


def read_json_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def fetch_missing(keys: DataFrame, cache: DataFrame, key: str, fetch: Callable[[str], tuple | None]) -> DataFrame:
    """cache and what fetch gives for the keys that it lacks; a key that fetch has nothing for (None) is kept with nulls.

    Each key is asked once, on the executors; the result is cache's next state, with its columns (key first). A key
    whose fetch raises isn't in it, so the next run asks again; service.fetch_resumed keeps failures with their causes.
    """
    columns = cache.columns
    new = keys.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct().join(cache.select(F.col(key).alias("k")), "k", "left_anti")

    def ask(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for k in b["k"]:
                with contextlib.suppress(Exception):  # a service's answer: no record, no harm
                    rows.append((k, *(fetch(k) or (None,) * (len(columns) - 1))))
            yield pd.DataFrame(rows, columns=columns)

    return cache.unionByName(new.mapInPandas(ask, cache.schema))
