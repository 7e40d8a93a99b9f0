"""Resumable embedding jobs: the work of a ticker is a unit, and a unit is done when the manifest names it.

    store/embeddings/ticker=.../    its documents' embeddings, in place of what an earlier attempt may have left
    store/manifest/                 (ticker, inputs, docs, run): appended when a wave's embeddings are written

Readers see committed units only, so a run may be killed at any time: what it wrote without committing is written again.
Whether a unit is done is asked of the manifest, never of the embeddings: a ticker without a document long enough is done too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import text
from ledgerline.operators.encode import Encoder, embed_documents
from ledgerline.session import cut, has_data
from ledgerline.sources import service, tables

#: Words that a cleaned filing and a transcript must have.
FILING_WORDS, TRANSCRIPT_WORDS = 2000, 500
_SUBMISSIONS = "struct<form: array<string>, filingDate: array<string>, reportDate: array<string>>"


def filing_documents(index: DataFrame, texts: DataFrame, least_words: int = FILING_WORDS) -> DataFrame:
    """(ticker, doc_date, text) of texts (ticker, year, text) whose year is in index (ticker, year, filed_date), cleaned and long enough.

    filed_date may be text; where it is no date, March 15 of the next year stands for it. Of an index's rows of one
    year the last date counts.
    """
    dates = index.groupBy("ticker", F.col("year").cast("int").alias("year")).agg(F.max(F.try_to_date(F.col("filed_date").cast("string"), "yyyy-MM-dd")).alias("filed_date"))
    fallback = F.make_date(F.col("year") + 1, F.lit(3), F.lit(15))
    docs = texts.select("ticker", F.col("year").cast("int").alias("year"), text.clean_filing(F.col("text")).alias("text")).where(text.word_count(F.col("text")) >= least_words)
    return docs.join(dates, ["ticker", "year"]).select("ticker", F.coalesce("filed_date", fallback).alias("doc_date"), "text")


def transcript_documents(files: DataFrame, index: DataFrame, least_words: int = TRANSCRIPT_WORDS) -> DataFrame:
    """(ticker, doc_date, text) of files (ticker, name, text) named Qn_YYYY.txt, long enough; dated by index (ticker, year, quarter, date), or else the 28th of the quarter's last month."""
    quarter, year = text.transcript_parts(F.col("name"))
    docs = files.select("ticker", quarter.alias("quarter"), year.alias("year"), "text").where(F.col("quarter").isNotNull() & (text.word_count(F.col("text")) >= least_words))
    day = F.try_to_date(F.left(F.col("date").cast("string"), F.lit(10)), "yyyy-MM-dd")
    dates = index.groupBy("ticker", F.col("quarter").cast("int").alias("quarter"), F.col("year").cast("int").alias("year")).agg(F.max(day).alias("call_date"))
    return text.with_transcript_dates(docs, dates).select("ticker", F.col("call_date").alias("doc_date"), "text")


def committed(spark: SparkSession, store: str) -> DataFrame:
    """(ticker, inputs, docs): each unit's last commit."""
    if not has_data(spark, f"{store}/manifest"):
        return spark.createDataFrame([], "ticker string, inputs long, docs long")
    m = spark.read.parquet(f"{store}/manifest")
    return m.groupBy("ticker").agg(F.max_by(F.struct("inputs", "docs"), "run").alias("x")).select("ticker", "x.*")


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The embeddings of committed units, as the embedding store has them."""
    done = committed(spark, store).where("docs > 0").select("ticker")
    if done.isEmpty():
        return spark.createDataFrame([], "ticker string, doc_date date, doc_type string, embedding array<float>, norm double, n_chunks int")
    e = spark.read.schema("doc_date date, doc_type string, embedding array<float>, norm double, n_chunks int, ticker string").parquet(f"{store}/embeddings")
    return e.join(done, "ticker", "left_semi").select("ticker", "doc_date", "doc_type", "embedding", "norm", "n_chunks")


def embed_units(documents: DataFrame, units: DataFrame, doc_type: str, store: str, encoder: Encoder | None = None, dim: int = 768, wave: int = 500, force: bool = False, changed: bool = False, each: Callable[[int], None] | None = None) -> int:
    """Embeds the documents (ticker, doc_date, text) of the units (ticker) that aren't committed, about `wave` of them at a time.

    force does all of them anew; changed does those too whose documents aren't the ones they were committed with. Every
    wave is one job over its own documents, then one short commit. Returns the number of units done.
    """
    spark = documents.sparkSession
    inputs = documents.groupBy("ticker").agg(F.sum(F.pmod(F.xxhash64("doc_date", "text"), F.lit(1 << 40))).alias("inputs"))
    units = units.select("ticker").where("ticker IS NOT NULL").distinct().join(inputs, "ticker", "left").select("ticker", F.coalesce("inputs", F.lit(0)).alias("inputs"))
    if not force:
        done = committed(spark, store)
        units = units.join(done, ["ticker", "inputs"] if changed else "ticker", "left_anti")
    units = cut(units.select("ticker", "inputs"))
    n = units.count()
    waves = -(-n // wave)
    run = 0
    if has_data(spark, f"{store}/manifest"):
        run = spark.read.parquet(f"{store}/manifest").agg(F.max("run")).first()[0] + 1
    for k in range(waves):
        if each:
            each(k)
        now = units.where(F.pmod(F.xxhash64("ticker"), F.lit(waves)) == k)
        found = embed_documents(documents.join(now.select("ticker"), "ticker", "left_semi"), ["ticker", "doc_date"], encoder, dim)
        made = cut(found.select("doc_date", F.lit(doc_type).alias("doc_type"), "embedding", "norm", "n_chunks", "ticker"))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(f"{store}/embeddings")
        docs = made.groupBy("ticker").agg(F.count("*").alias("docs"))
        now.join(docs, "ticker", "left").select("ticker", "inputs", F.coalesce("docs", F.lit(0)).alias("docs"), F.lit(run).cast("long").alias("run")).coalesce(1).write.mode("append").parquet(f"{store}/manifest")
    return n


def embed_filings(index: DataFrame, texts: DataFrame, store: str, **options: object) -> int:
    """The filings of all tickers of the index; options are embed_units'."""
    return embed_units(filing_documents(index, texts), index, "10-K", store, **options)


def embed_transcripts(files: DataFrame, index: DataFrame, store: str, **options: object) -> int:
    """The transcripts of all tickers that have files."""
    return embed_units(transcript_documents(files, index), files, "transcript", store, **options)


def submissions(pages: DataFrame, at: str | None) -> DataFrame:
    """(cik, ord, form, filing_date, report_date) of pages (cik, page, body), whose columns are parallel lists at a place of the JSON body."""
    kind = f"struct<filings: struct<{at}: {_SUBMISSIONS}>>" if at else _SUBMISSIONS
    body = F.from_json("body", kind)
    lists = body["filings"][at] if at else body
    rows = pages.select("cik", "page", lists.alias("x")).select("cik", "page", F.posexplode(F.arrays_zip("x.form", "x.filingDate", "x.reportDate")).alias("n", "r"))
    return rows.select("cik", (F.col("page") * F.lit(1 << 32) + F.col("n")).alias("ord"), F.col("r.form").alias("form"), F.col("r.filingDate").alias("filing_date"), F.nullif(F.col("r.reportDate"), F.lit("")).alias("report_date"))


def fetch_filing_dates(spark: SparkSession, index: DataFrame, store: str, url: str, older_url: str, **options: object) -> DataFrame:
    """index (ticker, cik, year, ...) with filed_date: of a company's annual reports by the service, or else March 15 of the year after.

    Two resumable fetches: each company's recent submissions, then the older pages that they name. What failed is asked
    again by the next call; until then its rows have the fallback.
    """
    options = {"retry_seconds": 10, "per_second": 8, "batch": 200, "pause_every": 0} | options
    padded = F.lpad(F.col("cik").cast("string"), 10, "0")
    service.fetch_resumed(spark, index.select(padded.alias("cik")), f"{store}/recent", "cik string, body string", url=url, fields={"body": ""}, **options)
    recent = service.current(spark.read.parquet(f"{store}/recent"), "cik")
    files = F.from_json("body", "struct<filings: struct<files: array<struct<name: string>>>>")["filings"]["files"]["name"]
    pages = cut(recent.select("cik", F.posexplode(files).alias("page", "name")))
    all_ = submissions(recent.withColumn("page", F.lit(0).cast("long")), "recent")
    service.fetch_resumed(spark, pages.select("name"), f"{store}/older", "name string, body string", url=older_url, fields={"body": ""}, **options)
    if has_data(spark, f"{store}/older"):
        older = service.current(spark.read.parquet(f"{store}/older"), "name")
        all_ = all_.unionByName(submissions(older.join(pages, "name").select("cik", (F.col("page") + 1).cast("long").alias("page"), "body"), None))
    dates = tables.filing_dates(all_).select(F.col("cik").alias("_cik"), F.col("year").alias("_year"), F.try_to_date("filed_date", "yyyy-MM-dd").alias("_date"))
    out = index.drop("filed_date").join(dates, (padded == F.col("_cik")) & (F.col("year") == F.col("_year")), "left")
    fallback = F.make_date(F.col("year").cast("int") + 1, F.lit(3), F.lit(15))
    return out.withColumn("filed_date", F.coalesce("_date", fallback)).drop("_cik", "_year", "_date")
