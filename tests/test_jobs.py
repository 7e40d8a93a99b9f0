"""Embedding jobs that are killed and run again, and the filing dates they stand on."""

import json

import pytest

from ledgerline.operators import jobs
from test_service import FAST, Stub

WORDS = "Item 1 of the report says that sales rose. "


def filings(spark):
    rows = [(f"T{k:02d}", y, f"Item 1 {k} {y} " + WORDS * (300 if (k + y) % 5 else 10)) for k in range(12) for y in (2018, 2019)]
    index = [(t, y, {2018: f"2019-02-{int(t[1:]) + 1:02d}", 2019: "nan"}[y]) for t, y, _ in rows] + [("EMPTY", 2018, "2019-01-01"), ("T00", 2018, "2019-01-20")]
    texts = spark.createDataFrame([*rows, ("T00", 2017, WORDS * 400), ("ELSE", 2018, WORDS * 400)], "ticker string, year int, text string")
    return spark.createDataFrame(index, "ticker string, year int, filed_date string"), texts


def rows(spark, store):
    return sorted(map(repr, jobs.stored(spark, store).collect()))


def test_filing_documents_and_dates(spark):
    got = {(r.ticker, str(r.doc_date)) for r in jobs.filing_documents(*filings(spark)).collect()}
    assert got == {(f"T{k:02d}", {2018: f"2019-02-{k + 1:02d}", 2019: "2020-03-15"}[y]) for k in range(12) for y in (2018, 2019) if (k + y) % 5}


def test_transcript_documents_and_dates(spark):
    long = "word " * 500
    files = spark.createDataFrame([("A", "Q1_2020.txt", long), ("A", "Q4_2020.txt", long), ("A", "Q2_2020.txt", "word " * 499), ("B", "notes.txt", long), ("B", "Q5_2020.txt", long), ("C", "Q3_2021.txt.bak", long)], "ticker string, name string, text string")
    index = spark.createDataFrame([("A", 2020, 1, "2020-04-30T17:00"), ("A", 2020, 4, "soon"), ("Z", 2020, 1, None)], "ticker string, year int, quarter int, date string")
    got = {(r.ticker, str(r.doc_date)) for r in jobs.transcript_documents(files, index).collect()}
    assert got == {("A", "2020-04-30"), ("A", "2020-12-28"), ("B", "2020-12-28"), ("C", "2021-09-28")}


@pytest.mark.parametrize("dies", ["before a wave", "between data and commit"])
def test_an_interrupted_run_repeated_gives_each_document_once(spark, tmp_path, dies, monkeypatch):
    index, texts = filings(spark)
    whole, broken = f"{tmp_path}/whole", f"{tmp_path}/broken"
    assert jobs.embed_filings(index, texts, whole, dim=8, wave=4) == 13
    want = rows(spark, whole)
    docs = jobs.filing_documents(index, texts)
    assert len(want) == docs.count() and jobs.committed(spark, whole).count() == 13

    def each(k):
        if k == 2 and dies == "before a wave":
            raise RuntimeError("killed")
        if k == 1 and dies != "before a wave":
            monkeypatch.setattr(jobs, "has_data", lambda *_: False)
            raise_on_commit(monkeypatch)

    with pytest.raises(Exception, match="killed"):
        jobs.embed_filings(index, texts, broken, dim=8, wave=4, each=each)
    monkeypatch.undo()
    half = rows(spark, broken)
    assert 0 < len(half) < len(want) and set(half) < set(want)  # committed units only
    left = jobs.embed_filings(index, texts, broken, dim=8, wave=4)
    assert 0 < left < 13 and rows(spark, broken) == want
    assert jobs.embed_filings(index, texts, broken, dim=8, wave=4) == 0 and rows(spark, broken) == want


def raise_on_commit(monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    real = DataFrameWriter.parquet

    def parquet(self, path, *a, **b):
        if path.endswith("manifest"):
            raise RuntimeError("killed")
        return real(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)


def test_forced_and_changed_units(spark, tmp_path):
    index, texts = filings(spark)
    store = f"{tmp_path}/store"
    jobs.embed_filings(index, texts, store, dim=8)
    want = rows(spark, store)
    assert jobs.embed_filings(index, texts, store, dim=8, changed=True) == 0
    fewer = texts.where("NOT (ticker = 'T01' AND year = 2018)")
    assert jobs.embed_filings(index, fewer, store, dim=8) == 0
    assert jobs.embed_filings(index, fewer, store, dim=8, changed=True) == 1 and len(rows(spark, store)) == len(want) - 1
    assert jobs.embed_filings(index, texts.where("ticker <> 'T02'"), store, dim=8, force=True) == 13
    assert not any("T02" in r for r in rows(spark, store)) and len(rows(spark, store)) < len(want)
    assert jobs.embed_filings(index, texts, store, dim=8, force=True) == 13 and rows(spark, store) == want


def test_filing_dates_from_a_service(spark, tmp_path):
    stub = Stub()
    lists = lambda *x: dict(zip(("form", "filingDate", "reportDate"), map(list, zip(*x)))) if x else {"form": [], "filingDate": [], "reportDate": []}
    bodies = {
        "0000000001": {"filings": {"recent": lists(("10-K/A", "2020-05-01", "2019-12-31"), ("10-K", "2020-02-20", "2019-12-31"), ("8-K", "2020-01-01", "2019-12-31"), ("10-K", "2021-02-21", ""), ("10-K/A", "2022-02-22", "2021-09-30")), "files": [{"name": "old-1.json"}, {"name": "old-2.json"}]}},
        "0000000002": {"filings": {"recent": lists(), "files": []}},
        "old-1.json": lists(("10-KSB", "2005-03-03", "2004-12-31"), ("10-K", "2020-02-25", "2019-12-31")),
    }
    real = stub.server.RequestHandlerClass.do_GET

    def do_get(self):
        key = self.path.split("/")[2]
        if key in bodies:
            stub.asked[key] += 1
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(bodies[key]).encode())
        else:
            real(self)

    stub.server.RequestHandlerClass.do_GET = do_get
    stub.broken |= {"old-2.json", "0000000003"}
    index = spark.createDataFrame([("A", "1", 2019), ("A", "1", 2021), ("A", "1", 2004), ("A", "1", 2003), ("B", "2", 2019), ("C", "3", 2019)], "ticker string, cik string, year int")
    call = lambda: {(r.ticker, r.year): str(r.filed_date) for r in jobs.fetch_filing_dates(spark, index, f"{tmp_path}/dates", stub.url, stub.url, **{k: v for k, v in FAST.items() if k != "records"}).collect()}
    want = {("A", 2019): "2020-02-25", ("A", 2021): "2022-02-22", ("A", 2004): "2005-03-03", ("A", 2003): "2004-03-15", ("B", 2019): "2020-03-15", ("C", 2019): "2020-03-15"}
    assert call() == want
    stub.broken.clear()
    bodies |= {"old-2.json": lists(("10-K", "2004-02-02", "2003-12-31")), "0000000003": {"filings": {"recent": lists(("10-K", "2020-04-04", "2019-12-31"))}}}
    assert call() == want | {("A", 2003): "2004-02-02", ("C", 2019): "2020-04-04"}
    assert stub.asked["0000000001"] == stub.asked["old-1.json"] == 1 and stub.asked["0000000003"] == 2
    stub.server.shutdown()
