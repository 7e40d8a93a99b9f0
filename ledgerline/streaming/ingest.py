"""Restartable news ingest: each micro-batch is merged into a store in a way that doing it twice changes nothing.

    store/articles/quarter=.../batch_id=...     dk, ts, tickers, text: what a batch brought that no earlier one had
    store/embeddings/batch_id=...               one row for each (ticker, quarter) whose articles the batch changed

A batch overwrites only partitions of its own number, so one that was cut short is simply done again. An article's key
holds its date, so its copies can only be in the same quarter: the merge reads the keys of the batch's quarters, never
the whole store. Embeddings are made anew for the changed (ticker, quarter) pairs alone; readers take each pair's last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline import schemas
from ledgerline.operators import text
from ledgerline.operators.encode import Encoder, embed_pieces
from ledgerline.session import cut, has_data, ship

#: Characters of an article that count, words that a quarter's document must have, characters below which a text is none.
ARTICLE_CHARS, LEAST_WORDS, LEAST_CHARS = 5000, 100, 20


def read_subsets(spark: SparkSession, root: str, tagged: list[str], untagged: list[str], files: int = 100, stream: bool = True) -> DataFrame:
    """(text, date, extra_fields, tagged) of root/<subset>/*.parquet, at most so many files a batch; other subsets aren't listed."""
    source = (spark.readStream.option("maxFilesPerTrigger", files) if stream else spark.read).schema(schemas.NEWS)
    rows = source.parquet(f"{root}/{{{','.join([*tagged, *untagged])}}}/*.parquet")
    subset = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)
    return rows.select("text", "date", "extra_fields", subset.isin(*tagged).alias("tagged"))


def articles(news: DataFrame) -> DataFrame:
    """(dk, ts, quarter, tags, title, text) of what is long enough and in range; tags are empty where a subset has none."""
    d = text.parse_date(F.col("date"))
    n = news.where(F.length("text") >= LEAST_CHARS).withColumn("d", d).where("d IS NOT NULL")
    tags = F.when(F.col("tagged"), text.tags(F.col("extra_fields"))).otherwise(F.array().cast("array<string>"))
    return n.select(text.dedup_key(F.col("text"), F.col("d")).alias("dk"), F.col("d").cast("timestamp").alias("ts"), F.trunc("d", "quarter").alias("quarter"), tags.alias("tags"), "tagged", "text")


def first_copies(found: DataFrame) -> DataFrame:
    """One row of each key: one with tags before one without, then the least text."""
    return found.groupBy("dk").agg(F.min_by(F.struct("ts", "quarter", "tags", "text"), F.struct(~F.col("tagged"), F.md5("text"), "text")).alias("x")).select("dk", "x.*")


def matched(found: DataFrame, tickers: DataFrame) -> DataFrame:
    """(dk, ts, quarter, tickers, text): known tickers among the tags, or else the title's; text is cut, and null without a ticker."""
    known = tickers.select("ticker").distinct()
    words = F.filter(F.array_distinct(F.split(F.upper(text.title(F.col("text"))), " ")), lambda w: F.length(w) >= 3)
    named = F.concat(F.transform("tags", lambda x: F.struct(x.alias("ticker"), F.lit(True).alias("tag"))), F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda x: F.struct(x.alias("ticker"), F.lit(False).alias("tag"))))
    # names alone meet the tickers; the texts meet what was found in one join
    hits = found.select("dk", F.inline(named)).join(known, "ticker").groupBy("dk").agg(F.array_sort(F.collect_set(F.when(F.col("tag"), F.col("ticker")))).alias("tagged_as"), F.min(F.when(~F.col("tag"), F.col("ticker"))).alias("titled_as"))
    out = found.join(hits, "dk", "left")
    tickers_ = F.when(F.size("tagged_as") > 0, F.col("tagged_as")).when(F.col("titled_as").isNotNull(), F.array("titled_as")).otherwise(F.array().cast("array<string>"))
    return out.select("dk", "ts", "quarter", tickers_.alias("tickers"), "text").withColumn("text", F.when(F.size("tickers") > 0, F.left("text", F.lit(ARTICLE_CHARS))))


def quarter_documents(store: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(ticker, doc_date, text) of (dk, ts, quarter, tickers, text): a quarter's articles in order of (ts, dk), dated at its end; enough words only."""
    rows = store.where("text IS NOT NULL").select(F.explode("tickers").alias("ticker"), "quarter", "ts", "dk", "text")
    if pairs is not None:
        rows = rows.join(pairs, ["ticker", "quarter"], "left_semi")
    docs = text.quarterly_concat(rows.select("ticker", F.col("quarter").alias("doc_date"), F.struct("ts", "dk").alias("doc_id"), "text"), ARTICLE_CHARS)
    end = F.date_sub(F.add_months("quarter", 3), 1)
    return docs.where(text.word_count(F.col("text")) >= LEAST_WORDS).select("ticker", end.alias("doc_date"), "text")


def quarter_embeddings(store: DataFrame, pairs: DataFrame | None, encoder: Encoder | None, dim: int) -> DataFrame:
    """The embeddings of quarter_documents(), whose articles stream through a task in order: no row holds a quarter's text."""
    key = ["ticker", "quarter"]
    rows = store.where("text IS NOT NULL").select(F.explode("tickers").alias("ticker"), "quarter", "ts", "dk", F.concat(F.left("text", F.lit(ARTICLE_CHARS)), F.lit("\n\n")).alias("text"))
    if pairs is not None:
        rows = rows.join(pairs, key, "left_semi")
    words = rows.groupBy(*key).agg(F.sum(text.word_count(F.col("text"))).alias("n")).where(F.col("n") >= LEAST_WORDS).select(*key)
    e = embed_pieces(rows.join(F.broadcast(words), key, "left_semi"), key, ["ts", "dk"], encoder, dim)
    return e.select("ticker", F.date_sub(F.add_months("quarter", 3), 1).alias("doc_date"), F.lit("news").alias("doc_type"), "embedding", "norm", "n_chunks")


def ingest_batch(news: DataFrame, tickers: DataFrame, encoder: Encoder | None = None, dim: int = 768) -> tuple[DataFrame, DataFrame]:
    """(articles, embeddings) of all news at once: what the stream's store must come to."""
    a = cut(matched(first_copies(articles(news)), tickers))
    return a, quarter_embeddings(a, None, encoder, dim)


def _overwrite(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merge(batch: DataFrame, batch_id: int, store: str, tickers: DataFrame, encoder: Encoder | None = None, dim: int = 768) -> None:
    """One micro-batch into the store; merging the same batch again gives the same store."""
    spark = batch.sparkSession
    new = cut(first_copies(batch))
    where = f"{store}/articles"
    quarters = [r.quarter for r in new.select("quarter").distinct().collect()]  # of 26 years: some hundred at most
    old = None
    if has_data(spark, where):
        old = spark.read.parquet(where).where(F.col("quarter").isin(quarters) & (F.col("batch_id") != batch_id))
        new = new.join(old.select("dk"), "dk", "left_anti")
    new = cut(matched(new, tickers).withColumn("batch_id", F.lit(batch_id)))
    _overwrite(new, where, "quarter", "batch_id")
    pairs = cut(new.select(F.explode("tickers").alias("ticker"), "quarter").distinct())
    columns = ["dk", "ts", "quarter", "tickers", "text"]
    changed = new.select(columns) if old is None else new.select(columns).unionByName(old.select(columns))
    made = quarter_embeddings(changed, pairs, encoder, dim).withColumn("batch_id", F.lit(batch_id))
    _overwrite(made, f"{store}/embeddings", "batch_id")


def ingest(news: DataFrame, tickers: DataFrame, store: str, checkpoint: str | None = None, encoder: Encoder | None = None, dim: int = 768, recent: str | None = None, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """A started query that merges a stream of news (see read_subsets) into the store until there is no more, and can be started again.

    recent: for how long (by arrival) copies are dropped already by the stream's own state, kept in RocksDB; copies
    that come later, and all copies without it, are found in the store. tickers is read anew for each batch.
    """
    spark = news.sparkSession
    ship(spark)
    found = articles(news)
    if recent:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        found = found.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", recent).dropDuplicatesWithinWatermark(["dk"]).drop("arrived")
    do = each or (lambda batch, n: merge(batch, n, store, tickers, encoder, dim))
    return found.writeStream.foreachBatch(do).option("checkpointLocation", checkpoint or f"{store}/checkpoint").trigger(availableNow=True).start()


def current_articles(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/articles").drop("batch_id")


def current_embeddings(spark: SparkSession, store: str) -> DataFrame:
    """The last embedding of every (ticker, quarter)."""
    e = spark.read.parquet(f"{store}/embeddings")
    key = ["ticker", "doc_date"]
    columns = [c for c in e.columns if c not in (*key, "batch_id")]
    return e.groupBy(*key).agg(F.max_by(F.struct(*columns), "batch_id").alias("x")).select(*key, "x.*")


def compacted(spark: SparkSession, store: str, target: str) -> None:
    """The store's current rows as one batch in another folder, without the embeddings that later ones replaced."""
    _overwrite(current_articles(spark, store).withColumn("batch_id", F.lit(-1)), f"{target}/articles", "quarter", "batch_id")
    _overwrite(current_embeddings(spark, store).withColumn("batch_id", F.lit(-1)), f"{target}/embeddings", "batch_id")
