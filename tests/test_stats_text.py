import math

from pyspark.sql import functions as F

from ledgerline.functions import stats
from ledgerline.operators import text


def test_tails():
    assert abs(stats.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-10 and abs(stats.chi2_sf(5.991464547107979, 2) - 0.05) < 1e-10
    assert abs(stats.t_two_sided(2.2281388519649385, 10) - 0.05) < 1e-9
    assert abs(stats.normal_quantile(0.05) + 1.6448536269514726) < 1e-12


def test_coverage(spark):
    r = spark.createDataFrame([(1000, 50), (1000, 0), (1000, 100), (0, 0)], "n long, v long").select(stats.kupiec_lr(F.col("n"), F.col("v"), 0.05).alias("lr")).collect()
    assert abs(r[0].lr) < 1e-9 and abs(r[1].lr + 2000 * math.log(0.95)) < 1e-6 and r[2].lr > 10 and r[3].lr is None


def test_cleaner(spark):
    long = "Abc " + "word " * 60
    cases = ["Item 1. Clean start " + long, "xbrl fasb.org 0000001\nItem 1. Body " + long, "xbrl " + "PART I toc " + long * 3 + "PART I body", "xbrl " + "x" * 900 + " PART I late", "xbrl zz " + long, "", "xbrl nothing"]
    got = [x[0] for x in spark.createDataFrame([(c,) for c in cases], "t string").select(text.clean_filing(F.col("t"))).collect()]
    assert got[0] == cases[0] and got[1].startswith("Item 1. Body") and got[2] == "PART I body" and got[3] == "PART I late" and got[4].startswith("Abc") and got[5] == "" and got[6] == cases[6]


def test_chunks_and_tags(spark):
    assert text.chunk_text("x" * 1792) == ["x" * 1792]
    parts = text.chunk_text("Mr. Smith of Acme Inc. sold it. " * 100, 100)
    assert len(parts) > 5 and all(p.endswith("it.") for p in parts)
    rows = [('{"stocks":["$AAPL","spx","A B","TOOLONGNAME","aapl"]}',), ("{bad",), ('{"stocks":5}',), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "e string").select(text.tags(F.col("e"))).collect()] == [["AAPL"], [], [], []]


def test_title_match(spark):
    d = spark.createDataFrame([(1, "News of ABC and XYZ today\n\nDEF"), (2, "no AB here")], "doc_id int, text string")
    n = spark.createDataFrame([("ABC",), ("XYZ",), ("DEF",), ("AB",)], "ticker string")
    assert [tuple(r) for r in text.title_matches(d, n, "doc_id").collect()] == [(1, "ABC")]
