"""One very long labelled text changes nothing that is learnt from the others."""

import zlib

import pytest

from ledgerline.llm import common, quality, toxicity
from tests_support import toxic_docs

SHORT = toxic_docs()[:300]
TAUGHT = [k for k, _, _ in SHORT if zlib.crc32(str(k).encode()) % 5]


def frames(spark, texts):
    d = spark.createDataFrame([(k, texts.get(k, t), "en", "s") for k, t, _ in SHORT], "doc_id long, text string, lang string, source string")
    return d, spark.createDataFrame([(k, y, y) for k, _, y in SHORT], "doc_id long, toxic int, quality int")


def in_hash_order(spark, salt):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k,) for k in TAUGHT], "k long").select("k", F.xxhash64(F.col("k").cast("string"), F.lit(salt)).alias("at")).orderBy("at").collect()
    return [r.k for r in rows]


@pytest.mark.parametrize("place", [0, 1, len(TAUGHT) // 2, -1])
def test_toxicity_with_a_long_text_at_any_place(spark, place):
    long = in_hash_order(spark, "toxicity")[place]
    probe = ["balori sute vilgrak namo", "balori sute namo", SHORT[0][1]]
    d, labels = frames(spark, {long: "lorem " * 50_000})
    got = toxicity.train(d, labels, train_chars=200_000).score(probe)
    d, labels = frames(spark, {long: None})
    assert abs(got - toxicity.train(d, labels).score(probe)).max() < 0.01
    assert got[0] > 0.9 and got[1] < 0.5


@pytest.mark.parametrize("place", [0, len(TAUGHT) // 2, -1])
def test_quality_with_a_long_text_at_any_place(spark, place):
    long = in_hash_order(spark, "quality")[place]
    d, labels = frames(spark, {long: "lorem " * 50_000})
    views = quality.train(d, labels, train_chars=200_000)
    d, labels = frames(spark, {long: None})
    want = quality.train(d, labels)
    for text in ("balori sute vilgrak namo dumskop zorfling", "balori sute namo"):
        assert abs(views.score(text, "en", "s")[0] - want.score(text, "en", "s")[0]) < 0.05
    scores = [views.score(t, "en", "s")[0] for _, t, _ in SHORT]
    assert max(scores) > 0.9 and min(scores) < 0.1  # no constant


def test_a_class_of_long_texts_only_still_teaches(spark):
    filler = "balori sute namo riteba lomo teri nasu monari. " * 12_000
    half = len(filler) // 2
    d, labels = frames(spark, {k: filler[:half] + "vilgrak dumskop vilgrak. " * 9000 + filler[half:] for k, _, y in SHORT if y and k < 30} | {k: None for k, _, y in SHORT if y and k >= 30})
    got = toxicity.train(d, labels).score(["vilgrak", "sumo"])
    assert got[0] != got[1]


def test_affordable():
    rows = [("a", "x" * 50), ("a", "x" * 5), ("b", "x" * 11), ("b", "x" * 40), ("a", "x" * 6), ("a", "x" * 9), ("a", None), ("c", "one two " * 30)]
    got = list(common.affordable(iter(rows), 1, lambda r: r[0], 12, 10))
    assert got == [("a", "x" * 5), ("a", "x" * 6), ("a", None), ("b", "x" * 10), ("c", "one two on")]
    t = " ".join(f"w{k}" for k in range(10_000))
    thin = common.thinned(t, 5000)
    assert len(thin) <= 5000 and {"w0", "w99"} <= set(thin.split()) <= set(t.split()) | {thin.split()[-1]} and any(int(w[1:] or 0) > 5000 for w in thin.split())
    assert common.thinned(" " * 100, 10) == ""
