"""Queries over ingest: a store that two batches were merged into, archives read back, table functions in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import table
from ledgerline.operators import jobs, text
from ledgerline.plans import tables as t
from ledgerline.plans.registry import query
from ledgerline.plans.text import _NAMES
from ledgerline.session import cut, shared_dir
from ledgerline.sources import npz
from ledgerline.streaming import ingest

#: Documents as news: two of three carry tags, dates lie in two years; the even ones come first.
_NEWS = """news AS (SELECT doc_id, doc_id % 2 AS batch, text, CAST(DATE '2020-01-01' + CAST(doc_id * 13 % 700 AS INT) AS DATE) AS d, doc_id % 3 <> 0 AS tagged, upper(source) AS tag FROM documents WHERE len(text) >= 20),
keyed AS (SELECT *, md5(lower(left(text, 80)) || '|' || strftime(d, '%Y-%m-%d')) AS dk FROM news),
one AS (SELECT *, row_number() OVER (PARTITION BY dk ORDER BY batch, NOT tagged, md5(text), text) AS rn FROM keyed),
kept AS (SELECT * FROM one WHERE rn = 1)"""
_MATCHED = f"""titled AS (SELECT dk, min(w) AS ticker FROM (SELECT dk, unnest(string_split(upper(CASE WHEN contains(text, chr(10) || chr(10)) THEN split_part(text, chr(10) || chr(10), 1) ELSE left(text, 200) END), ' ')) AS w FROM kept) WHERE w IN {_NAMES} AND len(w) >= 3 GROUP BY 1)"""


def _news(spark: SparkSession, d: str) -> DataFrame:
    x = t.read(spark, d, "documents")
    day = F.expr("date_add(DATE'2020-01-01', CAST(doc_id * 13 % 700 AS INT))")
    extra = F.to_json(F.struct(F.array(F.concat(F.lit("$"), "source")).alias("stocks")))
    return x.select("doc_id", "text", F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.when(F.col("doc_id") % 3 != 0, extra).alias("extra_fields"), (F.col("doc_id") % 3 != 0).alias("tagged"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    named = spark.createDataFrame([(n,) for n in _NAMES], "ticker string")
    return t.read(spark, d, "documents").select(F.upper("source").alias("ticker")).distinct().unionByName(named)


@query(
    "news_two_batches",
    f"WITH {_NEWS}, {_MATCHED} SELECT k.dk, CAST(date_trunc('quarter', d) AS DATE) AS quarter, CASE WHEN tagged THEN tag ELSE coalesce(t.ticker, '') END AS tickers, CASE WHEN tagged OR t.ticker IS NOT NULL THEN md5(left(text, 5000)) END AS text_md5 FROM kept k LEFT JOIN titled t USING (dk)",
)
def news_two_batches(spark: SparkSession, d: str) -> DataFrame:
    """All documents merged as two batches, the second twice: each article is in the store once."""
    store = f"{shared_dir(spark)}/news-{uuid.uuid4().hex}"
    news, names = _news(spark, d), cut(_names(spark, d))
    for n in (0, 1, 1):
        ingest.merge(ingest.articles(news.where(F.col("doc_id") % 2 == n)), n, store, names, dim=16)
    a = ingest.current_articles(spark, store)
    return a.select("dk", F.col("quarter").cast("date").alias("quarter"), F.array_join("tickers", ",").alias("tickers"), F.md5("text").alias("text_md5"))


@query(
    "news_quarter_documents",
    f"WITH {_NEWS}, {_MATCHED}, m AS (SELECT k.dk, d, CAST(date_trunc('quarter', d) AS DATE) AS quarter, CASE WHEN tagged THEN tag ELSE t.ticker END AS ticker, left(text, 5000) || chr(10) || chr(10) AS x FROM kept k LEFT JOIN titled t USING (dk)), c AS (SELECT ticker, quarter, string_agg(x, '' ORDER BY d, d, dk) AS text FROM m WHERE ticker IS NOT NULL GROUP BY ALL) SELECT ticker, CAST(quarter + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS doc_date, md5(text) AS text_md5 FROM c WHERE len(regexp_extract_all(text, '[^\\s\\x0B\\x85\\xA0]+')) >= 100",
)
def news_quarter_documents(spark: SparkSession, d: str) -> DataFrame:
    """The quarterly documents of the first copies, the earlier batch before the later one."""
    news = _news(spark, d)
    found = ingest.articles(news.where("doc_id % 2 = 0"))
    late = ingest.articles(news.where("doc_id % 2 = 1"))
    first = cut(ingest.first_copies(found))
    both = first.unionByName(ingest.first_copies(late).join(first.select("dk"), "dk", "left_anti"))
    docs = ingest.quarter_documents(ingest.matched(cut(both), _names(spark, d)))
    return docs.select("ticker", "doc_date", F.md5("text").alias("text_md5"))


@query(
    "npz_round_trip",
    "SELECT 'T' || CAST(label AS VARCHAR) AS ticker, CAST(DATE '2020-01-01' + CAST(vec_id * 7 % 1800 AS INT) AS DATE) AS doc_date, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm, CAST(1 + vec_id % 4 AS INT) AS n_chunks, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last, CAST(len(embedding) AS INT) AS dim FROM embeddings",
)
def npz_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All embeddings packed into an archive a ticker and read back with every check."""
    e = t.embeddings(spark, d).select("ticker", "doc_date", "doc_id")
    raw = t.read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = e.join(raw, "doc_id").select("ticker", "doc_date", "embedding", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("norm"), (1 + F.col("doc_id") % 4).cast("int").alias("n_chunks"))
    back = npz.decode_npz(npz.packed(rows))
    return back.select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("ticker"), "doc_date", F.round("norm", 5).alias("norm"), "n_chunks", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), F.round(F.element_at("embedding", 64).cast("double"), 6).alias("last"), F.size("embedding").alias("dim"))


@query("lateral_ticker_words", f"SELECT DISTINCT doc_id, w AS ticker FROM (SELECT doc_id, unnest(string_split(upper(CASE WHEN contains(text, chr(10) || chr(10)) THEN split_part(text, chr(10) || chr(10), 1) ELSE left(text, 200) END), ' ')) AS w FROM documents) WHERE len(w) >= 3 AND w IN {_NAMES}")
def lateral_ticker_words(spark: SparkSession, d: str) -> DataFrame:
    """Title words that are tickers, by the table function in SQL."""
    table.register(spark)
    named = spark.createDataFrame([(n,) for n in _NAMES], "ticker string")
    return spark.sql("SELECT x.doc_id, w.ticker FROM {docs} x, LATERAL ticker_words(x.text) w JOIN {named} n ON n.ticker = w.ticker", docs=t.read(spark, d, "documents"), named=named)


@query("lateral_chunks")
def lateral_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the query chunks, by the table function in SQL."""
    table.register(spark)
    return spark.sql("SELECT x.doc_id, c.chunk_no, char_length(c.chunk) AS n_chars, md5(c.chunk) AS chunk_md5 FROM {docs} x, LATERAL chunk_text(x.text) c", docs=t.read(spark, d, "documents"))


_FILED = """SELECT source AS ticker, CAST(2010 + doc_id % 10 AS INT) AS year, max(CASE WHEN doc_id % 4 <> 0 THEN make_date(2010 + doc_id % 10, 1 + doc_id % 12, 1) END) AS filed FROM documents GROUP BY ALL"""


@query(
    "filing_documents",
    f"WITH f AS ({_FILED}), x AS (SELECT source AS ticker, CAST(2010 + doc_id % 10 AS INT) AS year, 'Item 1 ' || text AS text FROM documents) SELECT x.ticker, coalesce(f.filed, make_date(x.year + 1, 3, 15)) AS doc_date, md5(x.text) AS text_md5 FROM x JOIN f USING (ticker, year) WHERE len(regexp_extract_all(x.text, '[^\\s\\x0B\\x85\\xA0]+')) >= 200",
)
def filing_documents(spark: SparkSession, d: str) -> DataFrame:
    """What the filing job embeds: cleaned texts of 200 words, dated by the index or the fallback."""
    f = t.filings(spark, d)
    index = f.select("ticker", "year", F.when(F.col("doc_id") % 4 != 0, F.col("doc_date").cast("string")).otherwise(F.lit("nan")).alias("filed_date"))
    docs = jobs.filing_documents(index, f.select("ticker", "year", F.concat(F.lit("Item 1 "), "text").alias("text")), least_words=200)
    return docs.select("ticker", "doc_date", F.md5("text").alias("text_md5"))
