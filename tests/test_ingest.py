"""News ingest: a run that is killed between (or inside) batches and started again leaves what one batch over all news gives."""

import json

import pytest

from ledgerline.streaming import ingest

TICKERS = ["ABC", "DEF", "XY", "WORD", "LONGISH"]


def story(k, words=60):
    return f"Story {k} on WORD markets\n\n" + " ".join(f"w{k}x{i}" for i in range(words))


def news():
    """Subset -> files -> rows (text, date, extra_fields)."""
    tag = lambda *x: json.dumps({"stocks": list(x)})
    row = lambda k, day, extra=None, words=60: (story(k, words), f"{day}T10:00:00Z", extra)
    return {
        "tagged_a": [
            [row(1, "2020-01-05", tag("$ABC", "SPX")), row(2, "2020-02-05", tag("DEF", "ABC")), row(3, "2020-02-05", tag("unknown")), ("too short", "2020-01-01", tag("ABC"))],
            [row(4, "2020-03-01", tag("abc")), row(1, "2020-01-05", tag("ABC")), row(5, "1999-03-01", tag("ABC")), row(6, "no date", tag("ABC")), (None, "2020-01-01", None)],
        ],
        "tagged_b": [[row(7, "2020-01-09", tag("ABC")), row(2, "2020-02-05", tag("DEF"))], [row(8, "2019-12-30", tag("DEF"), 150), row(9, "2020-06-30", "not json")]],
        "plain": [[row(10, "2020-05-01", tag("ABC"), 150), row(4, "2020-03-01")], [("Nothing known here at all, nothing.", "2020-05-01", None), row(11, "2020-01-20", None, 120)]],
        "other": [[row(12, "2020-05-01", tag("ABC"), 500)]],
    }


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("news")
    n = 0
    for subset, files in news().items():
        for rows in files:
            d = f"{tmp_path}/stage/{n}"
            spark.createDataFrame(rows, "text string, date string, extra_fields string").coalesce(1).write.parquet(d)
            (tmp_path / "news" / subset).mkdir(parents=True, exist_ok=True)
            next((tmp_path / "stage" / str(n)).glob("*.parquet")).rename(tmp_path / "news" / subset / f"{n}.parquet")
            n += 1
    return tmp_path


def tickers(spark):
    return spark.createDataFrame([(t,) for t in TICKERS], "ticker string")


def subsets(spark, root, stream, files=1):
    return ingest.read_subsets(spark, f"{root}/news", ["tagged_a", "tagged_b"], ["plain"], files, stream)


def rows(df, *drop):
    return sorted(map(repr, df.drop(*drop).select(*sorted(set(df.columns) - set(drop))).collect()))


def batch_rows(spark, root):
    a, e = ingest.ingest_batch(subsets(spark, root, False), tickers(spark), dim=16)
    return rows(a), rows(e)


def store_rows(spark, store):
    return rows(ingest.current_articles(spark, store)), rows(ingest.current_embeddings(spark, store))


def test_batch_against_plain_rules(spark, root):
    a, e = ingest.ingest_batch(subsets(spark, root, False), tickers(spark), dim=16)
    got = {r.text[:8] if r.text else None: tuple(r.tickers) for r in a.collect()}
    assert got["Story 1 "] == ("ABC",) and got["Story 2 "] in (("ABC", "DEF"), ("DEF",)) and got["Story 3 "] == ("WORD",) and got["Story 10"] == ("WORD",) and got["Story 4 "] == ("ABC",)
    assert a.count() == 10 and a.where("text IS NULL").count() == 1  # 1-4, 7-11 and the story without a ticker
    assert {(r.ticker, str(r.doc_date)) for r in e.collect()} == {("ABC", "2020-03-31"), ("DEF", "2019-12-31"), ("WORD", "2020-06-30"), ("WORD", "2020-03-31")}


@pytest.fixture(scope="module")
def whole(spark, root):
    """The store of a run that nothing interrupts, a batch a file."""
    store = f"{root}/whole"
    ingest.ingest(subsets(spark, root, True), tickers(spark), store, dim=16).awaitTermination()
    return store_rows(spark, store)


@pytest.mark.parametrize("recent", [None, "40 days"])
def test_stream_equals_batch(spark, root, recent):
    store = f"{root}/store-{recent}"
    ingest.ingest(subsets(spark, root, True), tickers(spark), store, dim=16, recent=recent).awaitTermination()
    assert spark.read.parquet(f"{store}/articles").select("batch_id").distinct().count() > 3
    (a, e), (wa, we) = store_rows(spark, store), batch_rows(spark, root)
    if recent:  # which copy of an article comes first is the stream's; its tags may differ
        assert len(a) == len(wa) and len(e) == len(we)
    assert recent or (a, e) == (wa, we) or _differ_by_first_copy(spark, store, root)
    ingest.ingest(subsets(spark, root, True), tickers(spark), store, dim=16, recent=recent).awaitTermination()
    assert store_rows(spark, store) == (a, e)  # nothing new, nothing changed
    ingest.compacted(spark, store, f"{store}-compact")
    assert store_rows(spark, f"{store}-compact") == (a, e)


def _differ_by_first_copy(spark, store, root):
    """Articles are the same but for the tags of a copy that came in an earlier batch than a better one."""
    a = {r.dk: (r.ts, r.quarter, r.text) for r in ingest.current_articles(spark, store).collect()}
    b = {r.dk: (r.ts, r.quarter, r.text) for r in ingest.ingest_batch(subsets(spark, root, False), tickers(spark), dim=16)[0].collect()}
    return a == b


@pytest.mark.parametrize("dies_at", [("before", 1), ("middle", 1), ("after", 2)])
def test_killed_and_restarted(spark, root, whole, dies_at, monkeypatch):
    """Killed before a batch, between its articles and its embeddings, or after both but before the commit."""
    want = whole
    where, at = dies_at
    broken = f"{root}/broken-{where}"
    real = ingest._overwrite

    def overwrite(df, path, *by):
        if where == "middle" and path.endswith("embeddings") and current[0] == at:
            raise RuntimeError("killed")
        real(df, path, *by)

    current = [None]

    def each(batch, n):
        current[0] = n
        if where == "before" and n == at:
            raise RuntimeError("killed")
        ingest.merge(batch, n, broken, tickers(spark), dim=16)
        if where == "after" and n == at:
            raise RuntimeError("killed")

    monkeypatch.setattr(ingest, "_overwrite", overwrite)
    with pytest.raises(Exception, match="killed"):
        ingest.ingest(subsets(spark, root, True), tickers(spark), broken, dim=16, each=each).awaitTermination()
    monkeypatch.setattr(ingest, "_overwrite", real)
    ingest.ingest(subsets(spark, root, True), tickers(spark), broken, dim=16).awaitTermination()
    assert store_rows(spark, broken) == want
    a = spark.read.parquet(f"{broken}/articles")
    assert a.select("dk").distinct().count() == a.count()  # each article once


def test_merging_a_batch_twice_changes_nothing(spark, root):
    store, batch = f"{root}/twice", ingest.articles(subsets(spark, root, False))
    ingest.merge(batch, 0, store, tickers(spark), dim=16)
    once = store_rows(spark, store)
    ingest.merge(batch, 0, store, tickers(spark), dim=16)
    assert store_rows(spark, store) == once
    ingest.merge(batch, 1, store, tickers(spark), dim=16)
    assert store_rows(spark, store) == once == batch_rows(spark, root)
