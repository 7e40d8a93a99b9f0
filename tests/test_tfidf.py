"""TF-IDF without rows of (document, word, date) that travel: plans, and weights against a plain program."""

import math
import random
import unicodedata

from pyspark.sql import functions as F

from ledgerline.operators import tfidf
from ledgerline.session import cut

DATES = ["2011-12-31", "2014-06-30", "2020-01-01"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(text):
    out = "".join(c if c == "_" or unicodedata.category(c)[0] in "LMN" else " " for c in (text or "").lower()).split()
    return [w for w in out if len(w) >= 2 and w not in tfidf.STOP_WORDS]


def documents(spark):
    rnd = random.Random(3)
    names = [f"w{k}" for k in range(25)] + ["m²", "été", "xé", "a_b", "the", "x"]
    rows = [(k, rnd.choice(["A", "B", "C", None]), f"20{rnd.randrange(10, 20)}-0{rnd.randrange(1, 10)}-15", rnd.choice([", ", "\n"]).join(rnd.choices(names, k=rnd.randrange(40)))) for k in range(150)]
    rows += [(900, "A", None, "w1 w2 " * 40), (901, "B", "2012-01-01", None), (902, "B", "2012-01-01", "")]
    df = spark.createDataFrame(rows, "doc_id long, ticker string, day string, text string").select("ticker", "doc_id", F.to_date("day").alias("doc_date"), "text")
    return rows, df, spark.createDataFrame([(d,) for d in DATES], "d string").select(F.to_date("d").alias("as_of"))


def plain(rows, features):
    """{(as_of, term): (df, total, n_docs)} and {(as_of, ticker, term): value}."""
    vocab, value = {}, {}
    for d in DATES:
        known = [(t, words(x)) for _, t, day, x in rows if day and day <= d]
        df = {w: sum(w in x for _, x in known) for _, y in known for w in y}
        total = {w: sum(x.count(w) for _, x in known) for w in df}
        best = sorted((w for w in df if 5 <= df[w] <= 0.95 * len(known)), key=lambda w: (-total[w], w))[:features] if len(known) >= 10 else []
        vocab |= {(d, w): (df[w], total[w], len(known)) for w in best}
        sums = {}
        for t, x in known:
            v = {w: (1 + math.log(x.count(w))) * (math.log((1 + len(known)) / (1 + df[w])) + 1) for w in best if w in x}
            for w in v if t else ():
                sums.setdefault(t, {}).setdefault(w, 0.0)
                sums[t][w] += v[w] / math.sqrt(sum(y * y for y in v.values()))
        value |= {(d, t, w): y / math.sqrt(sum(z * z for z in s.values())) for t, s in sums.items() for w, y in s.items()}
    return vocab, value


def test_weights_equal_a_plain_program(spark, monkeypatch):
    rows, docs, as_of = documents(spark)
    want_vocab, want = plain(rows, 12)
    vocab = cut(tfidf.vocabulary(docs, tfidf.terms(docs), as_of, max_features=12))
    assert {(str(r.as_of), r.term): (r.df, r.total, r.n_docs) for r in vocab.collect()} == want_vocab
    for n in (1, 7):
        got = {(str(r.as_of), r.ticker, r.term): r.value for r in tfidf.firm_vectors(docs.repartition(n), vocab).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 60
    assert tfidf.firm_vectors(docs, vocab.limit(0)).count() == 0


def test_sums_passed_on_in_parts_are_the_same(spark, monkeypatch):
    """Tiny bounds, so that each slice is a text and sums leave after each."""
    rows, docs, as_of = documents(spark)
    import pyarrow as pa

    table = pa.RecordBatch.from_pydict({"text": [r[3] for r in rows]})
    monkeypatch.setattr(tfidf, "_SLICE_BYTES", 1)
    cut_up = list(tfidf._slices(iter([table])))
    assert sum(b.num_rows for b in cut_up) == table.num_rows and all(b.num_rows == 1 or max(len(x or "") for x in b.column(0).to_pylist()) <= 1 for b in cut_up)


def test_terms_and_their_dates_meet_without_a_shuffle_of_documents(spark):
    _, docs, as_of = documents(spark)
    assert "Exchange" not in plan(tfidf.terms(docs))
    by_term = plan(tfidf.vocabulary(docs, tfidf.terms(docs), as_of))
    assert "SortMergeJoin" not in by_term and "doc_id" not in by_term.split("MapInArrow")[0]


def test_firm_vectors_shuffle_sums_only(spark):
    _, docs, as_of = documents(spark)
    vocab = cut(tfidf.vocabulary(docs, tfidf.terms(docs), as_of, max_features=12))
    found = plan(tfidf.firm_vectors(docs, vocab))
    assert "Join" not in found and found.count("Exchange hashpartitioning") <= 2 and "partial_sum" in found


def test_terms_added_up_where_they_are_read_are_the_same(spark):
    rows, docs, as_of = documents(spark)
    want, _ = plain(rows, 12)
    for n in (1, 7):
        got = tfidf.vocabulary(docs.repartition(n), None, as_of, max_features=12)
        assert {(str(r.as_of), r.term): (r.df, r.total, r.n_docs) for r in got.collect()} == want
    found = plan(tfidf.vocabulary(docs, None, as_of))
    assert "inline" not in found and "MapInArrow" in found and "monotonically_increasing_id" not in found
    assert tfidf.vocabulary(docs.limit(0), None, as_of).count() == 0


def test_a_row_group_is_dealt_over_tasks_to_count_its_terms(spark, tmp_path):
    """One file of one row group, as a plain writer makes it: without dealing, one task splits all of its texts."""
    _, docs, as_of = documents(spark)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    one = spark.read.parquet(str(tmp_path / "d"))
    assert "monotonically_increasing_id" in plan(tfidf.vocabulary(one, None, as_of)).split("MapInArrow")[-1]
    dealt = tfidf._spread(one)
    assert "Exchange hashpartitioning(at" in plan(dealt) and dealt.columns == one.columns and dealt.exceptAll(one).isEmpty() and dealt.count() == 153
    assert "Exchange" not in plan(tfidf._spread(docs))


def test_words_are_split_by_bytes_as_by_classes_of_code_points():
    import pyarrow as pa

    rnd = random.Random(5)
    points = [chr(c) for c in (*range(0x3000), *range(0xFE00, 0x10400), 0x1F642, 0x20000, 0xE0100, 0x10FFFF) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts = [None, "", " ", *("".join(rnd.choice(("ab", "b", "é", c)) for c in rnd.choices(points, k=40)) for _ in range(500))]
    words_of = tfidf.pc.ascii_split_whitespace(tfidf._spaced(pa.array(["skipped é–", *texts]).slice(1))).to_pylist()
    apart = tfidf.pc.split_pattern_regex(tfidf.pc.utf8_lower(pa.array(texts)), r"[^\p{L}\p{M}\p{N}_]+").to_pylist()
    assert [[w for w in x or [] if w] for x in words_of] == [[w for w in x or [] if w] for x in apart]


def test_a_row_group_is_dealt_over_tasks_to_weigh_its_terms(spark, tmp_path):
    rows, docs, as_of = documents(spark)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    one, vocab = spark.read.parquet(str(tmp_path / "d")), cut(tfidf.vocabulary(docs, None, as_of, max_features=12))
    found = tfidf.firm_vectors(one, vocab)
    assert "monotonically_increasing_id" in plan(found).split("MapInArrow")[-1]
    want = plain(rows, 12)[1]
    got = {(str(r.as_of), r.ticker, r.term): r.value for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
