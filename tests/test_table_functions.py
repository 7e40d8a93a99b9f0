"""Table functions, pieces of concatenations and carried vocabularies against the operators and plain rules."""

import hashlib
import json
import random

import pytest

from ledgerline.functions import table
from ledgerline.operators import text, tfidf
from pyspark.sql import functions as F

LONG = " ".join(f"Sentence number {k} of Mr. Smith goes on for a while, as U.S. reports do." for k in range(200))


def test_chunk_text_in_sql_equals_chunks(spark):
    table.register(spark)
    docs = spark.createDataFrame([(1, LONG), (2, "short"), (3, ""), (4, None), (5, LONG[::-1]), (6, "é" * 9000)], "doc_id long, text string")
    docs.createOrReplaceTempView("docs_to_chunk")
    for tokens in (512, 64):
        want = sorted(map(tuple, text.chunks(docs, ["doc_id"], max_tokens=tokens).collect()))
        got = spark.sql(f"SELECT d.doc_id, c.chunk_no, c.chunk FROM docs_to_chunk d, LATERAL chunk_text(d.text, max_tokens => {tokens}) c")
        assert sorted(map(tuple, got.collect())) == want and len(want) > 6
    assert spark.sql("SELECT c.* FROM docs_to_chunk d, LATERAL chunk_text(d.text) c WHERE d.doc_id = 2").collect() == [(0, "short")]


def test_arguments_are_checked(spark):
    table.register(spark)
    for call, said in (("chunk_text(5)", "must be a string"), ("chunk_text('a', max_tokens => 0)", "above 0"), ("chunk_text('a', max_tokens => 'x')", "above 0"), ("ticker_words(1)", "must be a string"), ("chunk_text(TABLE(SELECT 'a' AS t))", "not a table")):
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_ticker_words_equal_tag_and_title_matches(spark):
    table.register(spark)
    extra = [json.dumps({"stocks": x}) for x in (["$abc", "SPX", "A B", "LONGNAME", "abc$", None, 5], [], "ABC")] + ["no json", None, "[1]", "{}"]
    rows = [(k, t, e) for k, (t, e) in enumerate((t, e) for t in ("ABC and DEF rose\n\nXYZ fell", "xyz " * 80 + "ABC", "", None) for e in extra)]
    news = spark.createDataFrame(rows, "id long, text string, extra_fields string")
    news.createOrReplaceTempView("news_to_tag")
    tickers = spark.createDataFrame([("ABC",), ("DEF",), ("XYZ",)], "ticker string")
    tickers.createOrReplaceTempView("known_tickers")
    got = spark.sql("SELECT n.id, w.ticker, w.origin FROM news_to_tag n, LATERAL ticker_words(n.text, n.extra_fields) w JOIN known_tickers k ON k.ticker = w.ticker").collect()
    tags = {(r.id, r.ticker) for r in got if r.origin == "tag"}
    assert tags == {(r.id, r.ticker) for r in text.tag_matches(news, tickers, "id", "extra_fields").collect()} and tags
    titles = {}
    for r in got:
        if r.origin == "title":
            titles[r.id] = min(titles.get(r.id, r.ticker), r.ticker)
    assert titles == {r.id: r.ticker for r in text.title_matches(news, tickers, "id").collect()} and titles


@pytest.mark.parametrize("piece", [1 << 20, 500, 1])
def test_pieces_joined_are_the_whole(spark, piece):
    rnd = random.Random(1)
    rows = [(rnd.choice(["A", "B", None]), f"2020-{rnd.randrange(1, 7):02d}-{rnd.randrange(1, 29):02d}", k, rnd.choice(["word " * rnd.randrange(200), "é" * 90, "", None])) for k in range(300)]
    docs = spark.createDataFrame(rows, "ticker string, day string, doc_id long, text string").select("ticker", F.to_date("day").alias("doc_date"), "doc_id", "text")
    whole = {}
    for t, day, k, x in sorted(rows, key=lambda r: (r[1], r[2])):
        q = f"2020-{(int(day[5:7]) - 1) // 3 * 3 + 1:02d}-01"
        n, s = whole.get((t, q), (0, ""))
        whole[t, q] = (n + 1, s + ("" if x is None else x[:400] + "\n\n"))
    pieces = text.quarterly_pieces(docs, 400, piece)
    assert pieces.agg(F.max(F.length("text"))).first()[0] <= piece + 402
    got = {(r.ticker, str(r.quarter)): (r.n_docs, r.text_md5) for r in text.concat_digests(pieces).collect()}
    assert got == {k: (n, hashlib.md5(s.encode()).hexdigest()) for k, (n, s) in whole.items()}
    if piece > 1000:
        assert {(r.ticker, str(r.quarter)): (r.n_docs, r.text) for r in text.quarterly_concat(docs, 400).collect()} == whole
    else:
        assert pieces.count() > len(whole)


def test_vocabulary_as_of_each_date_equals_recounting(spark):
    rnd = random.Random(7)
    words = [f"w{k:02d}" for k in range(30)]
    rows = [(k, f"20{rnd.randrange(10, 20)}-0{rnd.randrange(1, 10)}-15", " ".join(rnd.choices(words, weights=range(1, 31), k=rnd.randrange(1, 25)))) for k in range(120)]
    dates = ["2009-01-01", "2010-06-30", "2012-12-31", "2015-04-15", "2019-12-31", "2025-01-01"]
    docs = spark.createDataFrame(rows, "doc_id long, day string, text string").select("doc_id", F.to_date("day").alias("doc_date"), "text")
    as_of = spark.createDataFrame([(d,) for d in dates], "d string").select(F.to_date("d").alias("as_of"))
    got = {(str(r.as_of), r.term): (r.df, r.total, r.n_docs, r.place) for r in tfidf.vocabulary(docs, tfidf.terms(docs), as_of, max_features=12).collect()}
    want = {}
    for d in dates:
        known = [t.split() for _, day, t in rows if day <= d]
        if len(known) >= 10:
            df = {w: sum(w in t for t in known) for w in words}
            total = {w: sum(t.count(w) for t in known) for w in words}
            best = sorted((w for w in words if 5 <= df[w] <= 0.95 * len(known)), key=lambda w: (-total[w], w))[:12]
            want |= {(d, w): (df[w], total[w], len(known), k + 1) for k, w in enumerate(best)}
    assert got == want and len({d for d, _ in want}) >= 4
