"""Incremental news ingest: parse, deduplicate within a watermark, count per ticker and calendar quarter."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import text
from ledgerline.session import shared_dir

#: How long a copy of an article can come after it and still be known; state older than that is dropped.
LATENESS = "40 days"


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(news: DataFrame, key: str, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """The first event of each key within the watermark; works on a stream or a batch."""
    if news.isStreaming:
        return news.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
    return news.dropDuplicates([key])


def parsed(news: DataFrame) -> DataFrame:
    """(dk, ts, quarter, tickers) of (text, date, extra_fields): long enough, in range, with a deduplication key."""
    d = text.parse_date(F.col("date"))
    return news.where(F.length("text") >= 20).withColumn("d", d).where("d IS NOT NULL").select(text.dedup_key(F.col("text"), F.col("d")).alias("dk"), F.col("d").cast("timestamp").alias("ts"), F.trunc("d", "quarter").alias("quarter"), text.tags(F.col("extra_fields")).alias("tickers"), "text")


def by_quarter(news: DataFrame) -> DataFrame:
    """(ticker, quarter, n): a calendar quarter isn't a fixed span, so it is a key and no window."""
    return news.select(F.explode("tickers").alias("ticker"), "quarter").groupBy("ticker", "quarter").agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, checkpoint: str | None = None, mode: str = "complete") -> DataFrame:
    """What the stream has for all files there are now, by a memory table; for tests and small reports."""
    spark = stream.sparkSession
    name = f"ledgerline_{uuid.uuid4().hex}"
    where = checkpoint or f"{shared_dir(spark) if not (spark.sparkContext.master or '').startswith('local') else tempfile.mkdtemp()}/{name}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
