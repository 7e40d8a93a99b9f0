"""What language models are learnt from: exactly bounded, whatever keys repeat and however long texts are."""

import random
import zlib

import numpy as np

from ledgerline.llm import language
from pyspark.sql import functions as F

KEYS = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 5]


def corpus():
    rnd = random.Random(6)
    words = {"en": "the cat and dog went with that thing over there".split(), "fr": "le chat et les chiens sont dans la maison que nous".split(), "xx": "zu zo za ze zi".split()}
    return [(k, " ".join(rnd.choice(words[lang]) for _ in range(12)), lang) for k, lang in zip(KEYS, __import__("itertools").cycle(["en", "en", "fr", "xx"]))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def same(a, b):
    return a.languages == b.languages and a.sharpness == b.sharpness and all(np.array_equal(x, y) for m, n in zip(a.models, b.models) for f in ("grams", "probs", "contexts", "left") for x, y in zip(getattr(m, f), getattr(n, f)))


def test_the_sample_is_exact(spark):
    rows = corpus()
    got = language.sample_of(frame(spark, rows), "doc_id", "text", "lang", 100).collect()
    count = {lang: sum(r.lang == lang for r in got) for lang in ("en", "fr", "xx")}
    assert count == {"en": 100, "fr": 100, "xx": 100}
    at = {r.k: r.at for r in frame(spark, rows).select(F.col("doc_id").alias("k"), F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")).alias("at")).collect()}
    spread = {k: at[k] % 1_000_000 for k in at}
    cut = {lang: 1e6 * (130 + 50) / sum(x == lang for _, _, x in rows) for lang in count}
    for lang in count:  # the least hashes of those within the rate; the rate is above what is needed by far more than the count can err
        chosen, left = {r.k for r in got if r.lang == lang}, {k for k, _, x in rows if x == lang}
        inside = sorted((at[k], k) for k in left if spread[k] < 0.9 * cut[lang])
        assert chosen <= left and len(inside) >= 100 and sum(k in chosen for _, k in inside[:60]) == 60


def test_a_key_of_many_rows_counts_once(spark):
    rows = corpus()
    hot = language.sample_of(frame(spark, rows), "doc_id", "text", "lang", 100).where("lang = 'en'").orderBy("at").first()
    df = frame(spark, rows)
    many = df.unionByName(spark.range(200_000).select(F.lit(hot.k).cast("long").alias("doc_id"), F.lit(hot.text).alias("text"), F.lit("en").alias("lang")))
    assert same(language.train(df, train_docs=100), language.train(many, train_docs=100))


def test_long_texts_neither_teach_nor_crowd_out(spark):
    rows = corpus()
    hot = language.sample_of(frame(spark, rows), "doc_id", "text", "lang", 100).where("lang = 'fr'").orderBy("at").first().k
    long = language.train(frame(spark, [(k, "qqq " * 100_000 if k == hot else t, x) for k, t, x in rows]), train_docs=100)
    assert len(long.models[1].grams[-1]) <= len(language.train(frame(spark, rows), train_docs=100).models[1].grams[-1])
    only = language.train(frame(spark, [(k, t * 100 if x == "xx" else t, x) for k, t, x in rows]), train_docs=100, row_chars=900)
    assert only.languages == ["en", "fr", "xx"] and only.predict(["zu zo za", "the cat"])[0][0] == "xx"
