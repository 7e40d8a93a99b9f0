"""Queries over texts: counts, cleaning, deduplication, tags, concatenation, TF-IDF, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import encode, text, tfidf
from ledgerline.plans import tables as t
from ledgerline.plans.registry import query, rounded


@query("word_counts", "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\s\\x0B\\x85\\xA0]+')) AS INT) AS n_words FROM documents")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


#: Documents as if they were filings: a mark before, inside or nowhere, chosen by the id.
_MARKED = """CASE doc_id % 4 WHEN 0 THEN 'xbrl 2010 ' || text || ' Item 1. Business ' || left(text, 300) WHEN 1 THEN 'Item 1 ' || text WHEN 2 THEN 'fasb.org Item 1. here ' || text || ' ITEM 1 again ' || text ELSE text END"""


def _marked() -> F.Column:
    return F.expr(_MARKED.replace("CASE doc_id % 4", "CASE CAST(doc_id % 4 AS INT)"))


@query(
    "filing_clean",
    f"""WITH m AS (SELECT doc_id, {_MARKED} AS t FROM documents), h AS (SELECT doc_id, t, left(t, 500) AS head FROM m)
SELECT doc_id, md5(CASE WHEN regexp_matches(head, '(Item\\s+1|PART\\s+I|UNITED\\s+STATES|FORM\\s+10-K|ANNUAL\\s+REPORT)', 'i') AND NOT regexp_matches(head, '(fasb\\.org|xbrl|false\\d{{4}}FY|\\.htm\\b|0{{6,}}\\d+\\n|--\\d{{2}}-\\d{{2}}\\nFY)', 'i') THEN t
  WHEN doc_id % 4 = 0 THEN substr(t, strpos(t, 'Item 1. Business')) WHEN doc_id % 4 = 2 THEN substr(t, CASE WHEN 9 < len(t) * 0.2 THEN strpos(t, 'ITEM 1 again') ELSE 10 END)
  WHEN regexp_matches(t, '[A-Z][a-z].{{198,}}', 's') THEN regexp_extract(t, '[A-Z][a-z].{{198,}}', 0, 's') ELSE t END) AS cleaned_md5 FROM h""",
)
def filing_clean(spark: SparkSession, d: str) -> DataFrame:
    m = t.read(spark, d, "documents").select("doc_id", _marked().alias("t"))
    return m.select("doc_id", F.md5(text.clean_filing(F.col("t"))).alias("cleaned_md5"))


@query("dedup_max_words", t.sql(t.FILINGS, "r AS (SELECT *, row_number() OVER (PARTITION BY ticker, year ORDER BY len(text) DESC, doc_id) AS rn FROM filings)", "SELECT ticker, year, doc_id FROM r WHERE rn = 1"))
def dedup_max_words(spark: SparkSession, d: str) -> DataFrame:
    f = t.filings(spark, d).withColumn("n", F.length("text"))
    return text.keep_most_words(f, ["ticker", "year"], "n", "doc_id").select("ticker", "year", "doc_id")


@query("dedup_keep_last", t.sql(t.FILINGS, "SELECT ticker, year, max(doc_id) AS doc_id FROM filings GROUP BY ALL"))
def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return text.keep_last(t.filings(spark, d), ["ticker", "year"], "doc_id").select("ticker", "year", "doc_id")


@query("dedup_md5", t.sql(t.FILINGS, "SELECT md5(lower(left(text, 80)) || '|' || strftime(doc_date, '%Y-%m-%d')) AS dk, min(doc_id) AS doc_id FROM filings GROUP BY 1"))
def dedup_md5(spark: SparkSession, d: str) -> DataFrame:
    return t.filings(spark, d).groupBy(text.dedup_key(F.col("text"), F.col("doc_date")).alias("dk")).agg(F.min("doc_id").alias("doc_id"))


@query("parse_dates", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE CAST(ts AS DATE) END AS date FROM events")
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    e = t.read(spark, d, "events")
    s = F.when(F.col("event_id") % 5 == 0, F.lit("2024-13-45")).when(F.col("event_id") % 5 == 1, F.lit("1999-01-01")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", text.parse_date(s).alias("date"))


_TAGS = """x AS (SELECT event_id, list_transform([('$' || event_type), upper(event_type || '$'), 'SPX', 'a b', 'LONGNAME'], lambda s: trim(regexp_replace(upper(s), '^\\$+|\\$+$', '', 'g'))) AS l FROM events)"""


@query("json_ticker_tags", t.sql(_TAGS, "SELECT event_id, unnest(list_sort(list_distinct(list_filter(l, lambda s: len(s) BETWEEN 1 AND 6 AND NOT contains(s, ' ') AND s NOT IN ('INDU', 'SPX', 'COMP', 'DJI', 'NDX', 'VIX'))))) AS ticker FROM x"))
def json_ticker_tags(spark: SparkSession, d: str) -> DataFrame:
    extra = F.to_json(F.struct(F.array(F.concat(F.lit("$"), "event_type"), F.upper(F.concat("event_type", F.lit("$"))), F.lit("SPX"), F.lit("a b"), F.lit("LONGNAME")).alias("stocks")))
    return t.read(spark, d, "events").select("event_id", F.explode(text.tags(extra)).alias("ticker"))


_TITLE = "w AS (SELECT doc_id, unnest(list_distinct(string_split(upper(CASE WHEN contains(text, chr(10) || chr(10)) THEN split_part(text, chr(10) || chr(10), 1) ELSE left(text, 200) END), ' '))) AS ticker FROM documents)"
_NAMES = ("THE", "DER", "LES", "QUE", "AND", "UND", "OF")


@query("title_match", t.sql(_TITLE, f"SELECT doc_id, min(ticker) AS ticker FROM w WHERE len(ticker) >= 3 AND ticker IN {_NAMES} GROUP BY 1"))
def title_match(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in _NAMES], "ticker string")
    return text.title_matches(t.read(spark, d, "documents"), names, "doc_id")


@query("quarterly_concat", t.sql(t.FILINGS, "SELECT ticker, CAST(date_trunc('quarter', doc_date) AS DATE) AS quarter, count(*) AS n_docs, md5(string_agg(left(text, 5000) || chr(10) || chr(10), '' ORDER BY doc_date, doc_id)) AS text_md5 FROM filings GROUP BY ALL"))
def quarterly_concat(spark: SparkSession, d: str) -> DataFrame:
    return text.concat_digests(text.quarterly_pieces(t.filings(spark, d)))


@query("transcript_concat", "SELECT conv_id, count(*) AS n_docs, md5(string_agg(left(text, 5000) || chr(10) || chr(10), '' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1")
def transcript_concat(spark: SparkSession, d: str) -> DataFrame:
    c = t.read(spark, d, "conversations").select(F.col("conv_id").alias("ticker"), F.lit("2024-01-01").cast("date").alias("doc_date"), F.col("turn").alias("doc_id"), "text")
    return text.concat_digests(text.quarterly_pieces(c)).select(F.col("ticker").alias("conv_id"), "n_docs", "text_md5")


_STOP = "(" + ", ".join(f"'{w}'" for w in tfidf.STOP_WORDS) + ")"
_TERMS = f"tm AS (SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}')) AS w FROM documents) WHERE w NOT IN {_STOP} GROUP BY ALL)"
_DATES = "ad AS (SELECT CAST(d AS DATE) AS as_of FROM (SELECT unnest([DATE '2013-06-30', DATE '2016-06-30', DATE '2020-01-01']) AS d))"
_VOCAB = """nd AS (SELECT as_of, count(*) AS n_docs FROM filings JOIN ad ON doc_date <= as_of GROUP BY 1),
vo AS (SELECT as_of, term, count(*) AS df, sum(tf) AS total FROM tm JOIN filings USING (doc_id) JOIN ad ON doc_date <= as_of GROUP BY ALL),
vr AS (SELECT as_of, term, df, CAST(total AS BIGINT) AS total, n_docs, row_number() OVER (PARTITION BY as_of ORDER BY total DESC, term) AS place FROM vo JOIN nd USING (as_of) WHERE df >= 5 AND df <= n_docs * 0.95),
voc AS (SELECT * FROM vr WHERE place <= 200)"""


def _tfidf(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = t.filings(spark, d)
    dates = spark.createDataFrame([("2013-06-30",), ("2016-06-30",), ("2020-01-01",)], "s string").select(F.col("s").cast("date").alias("as_of"))
    return docs, tfidf.vocabulary(docs, None, dates, max_features=200)


@query("tfidf_top_terms", t.sql(t.FILINGS, _TERMS, _DATES, _VOCAB, "SELECT as_of, term, df, total, n_docs, CAST(place AS INT) AS place FROM voc"))
def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return _tfidf(spark, d)[1]


_VECTORS = """wx AS (SELECT v.as_of, f.ticker, f.doc_id, v.term, (1 + ln(tm.tf)) * (ln((1 + v.n_docs) / (1 + v.df)) + 1) AS x FROM tm JOIN filings f USING (doc_id) JOIN voc v ON v.term = tm.term AND f.doc_date <= v.as_of),
le AS (SELECT as_of, doc_id, sqrt(sum(x * x)) AS l FROM wx GROUP BY ALL), cn AS (SELECT as_of, ticker, count(*) AS n FROM filings JOIN ad ON doc_date <= as_of GROUP BY ALL),
fv AS (SELECT wx.as_of, wx.ticker, wx.term, sum(x / l) / any_value(cn.n) AS v FROM wx JOIN le USING (as_of, doc_id) JOIN cn ON cn.as_of = wx.as_of AND cn.ticker = wx.ticker GROUP BY ALL),
fn AS (SELECT as_of, ticker, sqrt(sum(v * v)) AS nrm FROM fv GROUP BY ALL)"""


@query("tfidf_firm_vectors", t.sql(t.FILINGS, _TERMS, _DATES, _VOCAB, _VECTORS, "SELECT as_of, ticker, term, round(v / nrm, 6) AS value FROM fv JOIN fn USING (as_of, ticker)"))
def tfidf_firm_vectors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tfidf.firm_vectors(*_tfidf(spark, d)))


@query("chunks")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return text.chunks(t.read(spark, d, "documents"), ["doc_id"]).select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query("document_embeddings")
def document_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = encode.embed_documents(t.read(spark, d, "documents").select("doc_id", "text"), ["doc_id"], dim=64)
    return e.select("doc_id", "n_chunks", F.round("norm", 5).alias("norm"), F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


@query("filing_date_lookup", t.sql(t.FILINGS, "dt AS (SELECT ticker, year, max(doc_date) AS filed FROM filings WHERE year % 2 = 0 GROUP BY ALL)", "SELECT f.doc_id, coalesce(d.filed, make_date(f.year + 1, 3, 15)) AS filed_date FROM filings f LEFT JOIN dt d ON d.ticker = f.ticker AND d.year = f.year"))
def filing_date_lookup(spark: SparkSession, d: str) -> DataFrame:
    f = t.filings(spark, d)
    dates = f.where("year % 2 = 0").groupBy("ticker", "year").agg(F.max("doc_date").alias("filed_date"))
    return text.with_filing_dates(f, dates).select("doc_id", "filed_date")


@query("resume_anti_join", t.sql(t.FILINGS, "SELECT DISTINCT ticker FROM filings WHERE ticker NOT IN (SELECT ticker FROM filings WHERE doc_id % 40 = 0)"))
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    f = t.filings(spark, d)
    return text.pending(f.select("ticker").distinct(), f.where("doc_id % 40 = 0"))


@query("missing_tickers_except", "SELECT ticker FROM (SELECT DISTINCT p_brand AS ticker FROM part EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_size > 49)")
def missing_tickers_except(spark: SparkSession, d: str) -> DataFrame:
    p = t.read(spark, d, "part")
    return p.select(F.col("p_brand").alias("ticker")).subtract(p.where("p_size > 49").select("p_brand"))
