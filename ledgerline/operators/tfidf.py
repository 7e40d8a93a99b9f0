"""Walk-forward TF-IDF as relations: terms, document frequencies and weights per as-of date."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: English function words that carry no content; a setting of the encoder.
STOP_WORDS = tuple(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have"
    " having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then"
    " there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)


#: A code point of a word, as RE2 writes it, and the bytes of text that a task splits at once (or one text).
_OF_WORD, _SLICE_BYTES = r"[\p{L}\p{M}\p{N}_]", 1 << 22
#: Every byte, with a space for ASCII that stands between words.
_SPACED = np.array([b if b > 127 or chr(b).isalnum() or b == 95 else 32 for b in range(256)], np.uint8)
#: Sums that a task holds before it passes them on, and rows of terms' sums.
_HELD, _HELD_ROWS = 1 << 22, 1 << 20


def terms(docs: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(what docs has but its text, term, tf): lower-case words of two or more letters, marks, digits or underscores.

    A row of docs is a document: its words are counted where it is read, so no (document, word) row travels for that.
    """
    import pyarrow as pa

    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in docs.dtypes if c != "text"), "counted array<struct<term string, tf bigint>>"])

    def count(batches: Iterator) -> Iterator:
        for b in _slices(batches):
            row, code, tf, known = _counts(b.column("text"), stop_words)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([known.take(pa.array(code)), pa.array(tf)], names=["term", "tf"]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], listed], names=[*kept, "counted"])

    return docs.select(*kept, F.make_valid_utf8("text").alias("text")).mapInArrow(count, schema).select(*kept, F.inline("counted"))


def _slices(batches: Iterator) -> Iterator:
    """Runs of rows with about _SLICE_BYTES of text, or one longer text."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _SLICE_BYTES, "right")))
            yield b.slice(at, end - at)
            at = end


def _spaced(text):  # noqa: ANN001
    """The texts in lower case, each byte of what stands between words a space: splitting at spaces is far cheaper than at a class of code points."""
    import pyarrow as pa

    low = pc.utf8_lower(text)
    ends = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1]
    held = _SPACED[np.frombuffer(low.buffers()[2] or b"", np.uint8)[: ends[-1]]]
    lead = np.flatnonzero(held >= 0xC0)
    lead = lead[lead >= ends[0]]
    if len(lead):
        size = 2 + (held[lead] >= 0xE0) + (held[lead] >= 0xF0)
        point = held[lead].astype(np.int64) & (0x7F >> size)
        for k in range(1, 4):
            on = size > k
            point[on] = point[on] << 6 | held[lead[on] + k] & 0x3F
        met, which = np.unique(point, return_inverse=True)
        between = ~pc.match_substring_regex(pa.array([chr(c) for c in met]), _OF_WORD).to_numpy(zero_copy_only=False)[which]
        for k in range(4):
            held[lead[between & (size > k)] + k] = 32
    return pa.Array.from_buffers(low.type, len(low), [low.buffers()[0], low.buffers()[1], pa.py_buffer(held)], offset=low.offset)


def _codes(text, stop_words: tuple[str, ...] = (), known=None) -> tuple:  # noqa: ANN001
    """(row, place) of every term of the texts, repeats included, and the terms that places count in (known, if given)."""
    import pyarrow as pa

    words = pc.ascii_split_whitespace(_spaced(text))
    row, flat = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words)
    if known is None:
        flat = flat.dictionary_encode()
        known = flat.dictionary
        here = np.arange(len(known))
        here[~pc.and_(pc.greater(pc.utf8_length(known), 1), pc.invert(pc.is_in(known, pa.array(stop_words, pa.string())))).to_numpy(zero_copy_only=False)] = -1
        code = here[flat.indices.to_numpy()]
    else:
        code = pc.fill_null(pc.index_in(flat, known), -1).to_numpy()
    on = code >= 0
    return row[on].astype(np.int64), code[on].astype(np.int64), known


def _counts(text, stop_words: tuple[str, ...] = (), known=None) -> tuple:  # noqa: ANN001
    """(row, place, times) of the terms of each text in order of (row, place), and the terms that places count in (known, if given)."""
    row, code, known = _codes(text, stop_words, known)
    key, times = np.unique(row * max(len(known), 1) + code, return_counts=True)
    return key // max(len(known), 1), key % max(len(known), 1), times, known


def _spread(rows: DataFrame) -> DataFrame:
    """rows; dealt anew if one task reads over twice its share: a row group of a file is one task's, however much it holds."""
    most, n = rows.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.sum("count")).first()
    if not n or most * rows.sparkSession.sparkContext.defaultParallelism <= 2 * n:
        return rows
    return rows.withColumn("at", F.monotonically_increasing_id()).repartition("at").drop("at")


def _sums(rows: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, q, df, total) of rows (q, text): added up where a document is read, several rows for a (term, q)."""
    import pyarrow as pa

    def add(batches: Iterator) -> Iterator:
        held = []
        for b in _slices(batches):
            row, code, known = _codes(b.column("text"), stop_words)
            if not len(row):
                continue
            n = len(known)
            key, times = np.unique((b.column("q").to_numpy()[row] * np.int64(n) + code) * b.num_rows + row, return_counts=True)
            key //= b.num_rows
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            df, total = np.diff(starts, append=len(key)), np.add.reduceat(times, starts)
            held.append(pa.table({"term": known.take(pa.array(key[starts] % n)), "q": pa.array((key[starts] // n).astype(np.int32)), "df": df, "total": total}))
            if sum(map(len, held)) >= _HELD_ROWS:
                yield from passed(held)
                held = []
        if held:
            yield from passed(held)

    def passed(held: list) -> Iterator:
        by = pa.concat_tables(held).group_by(["term", "q"], use_threads=False).aggregate([("df", "sum"), ("total", "sum")])
        yield from by.select(["term", "q", "df_sum", "total_sum"]).rename_columns(["term", "q", "df", "total"]).to_batches()

    return rows.select("q", F.make_valid_utf8("text").alias("text")).mapInArrow(add, "term string, q int, df bigint, total bigint")


def _known(rows: DataFrame, dates: list) -> DataFrame:
    """rows with q, the place from 0 of the first of the sorted dates that doc_date is known at; later ones and those without a date are left out."""
    q = F.lit(None).cast("int")
    for k, day in reversed(list(enumerate(dates))):
        q = F.when(F.col("doc_date") <= F.lit(day), k).otherwise(q)
    return rows.withColumn("q", q).where("q IS NOT NULL")


def vocabulary(docs: DataFrame, terms_: DataFrame | None, as_of: DataFrame, min_df: int = 5, max_df: float = 0.95, max_features: int = 768) -> DataFrame:
    """(as_of, term, df, n_docs, place): of the terms in at least min_df and at most max_df of the documents so far, those of highest total.

    A document counts once, at the first as-of date it is known at; running sums of each term carry it on, so history
    isn't joined with the dates after it. Dates are few, one a rebalance. terms_ are terms() of docs with their
    doc_date, so the two never meet in a join; without them the tasks that read docs add their terms up and pass on
    sums. Terms that no date can take go before the running sums.
    """
    kind = dict(as_of.dtypes)["as_of"]
    dates = sorted(r.as_of for r in as_of.select("as_of").distinct().collect() if r.as_of)
    listed = F.array(*map(F.lit, dates)).cast(f"array<{kind}>")

    def carried(counts: DataFrame, by: list[str], *sums: str) -> DataFrame:
        """Running sums of (by, q, sums), at every date from the first on."""
        w = Window.partitionBy(*by).orderBy("q")
        run = counts.select(*by, "q", *[F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(c) for c in sums], F.coalesce(F.lead("q").over(w), F.lit(len(dates))).alias("next"))
        return run.withColumn("q", F.explode(F.sequence("q", F.col("next") - 1))).select(*by, F.element_at(listed, F.col("q") + 1).alias("as_of"), *sums)

    n = carried(_known(docs, dates).groupBy("q").agg(F.count("*").alias("n_docs")).withColumn("all", F.lit(0)), ["all"], "n_docs").drop("all").where("n_docs >= 10")
    if terms_ is None:
        by_term = _sums(_spread(_known(docs, dates).select("q", "text"))).groupBy("term", "q").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    else:
        by_term = _known(terms_, dates).groupBy("term", "q").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    by_term = by_term.withColumn("all", F.sum("df").over(Window.partitionBy("term"))).where(F.col("all") >= min_df).drop("all")
    v = carried(by_term, ["term"], "df", "total").join(F.broadcast(n), "as_of").where((F.col("df") >= min_df) & (F.col("df") <= F.col("n_docs") * max_df))
    best = F.row_number().over(Window.partitionBy("as_of").orderBy(F.col("total").desc(), "term"))  # the first of each task before the shuffle
    return v.withColumn("place", best).where(F.col("place") <= max_features).select("as_of", "term", "df", "total", "n_docs", "place")


def firm_vectors(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(as_of, ticker, term, value): mean of the tickers' unit document vectors (1 + ln tf, smoothed idf), again of unit length.

    The vocabulary, max_features terms a date, goes to the tasks; they weigh a document at all its dates where it is read
    and pass on sums by (date, ticker, term). So neither its terms nor its weights travel; a mean and a sum have one direction.
    """
    import pyarrow as pa

    rows = vocab.select("as_of", "term", (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf")).collect()
    dates, names = sorted({r.as_of for r in rows}), sorted({r.term for r in rows})
    place, at = {t: k for k, t in enumerate(names)}, {a: k for k, a in enumerate(dates)}
    idf = np.zeros((len(dates), len(names)))
    for r in rows:
        idf[at[r.as_of], place[r.term]] = r.idf
    listed = F.array(*map(F.lit, dates)).cast(f"array<{dict(vocab.dtypes)['as_of']}>")

    def add(batches: Iterator) -> Iterator:
        held, known = {}, pa.array(names, pa.string())
        for b in _slices(batches):
            row, term, tf, _ = _counts(b.column("text"), known=known)
            ticker = b.column("ticker").dictionary_encode()
            who, first = ticker.indices.to_numpy()[row], b.column("q").to_numpy()[row]
            order = np.argsort(first, kind="stable")
            row, term, who, first, weight = row[order], term[order], who[order], first[order], 1 + np.log(tf[order])
            for k in range(len(dates)):
                n = int(np.searchsorted(first, k, "right"))
                x = weight[:n] * idf[k, term[:n]]
                length = np.sqrt(np.bincount(row[:n], x * x, b.num_rows))[row[:n]]
                on = x > 0
                sums = np.bincount(who[:n][on] * len(names) + term[:n][on], x[on] / length[on], len(ticker.dictionary) * len(names)).reshape(-1, len(names))
                for i in np.flatnonzero(sums.any(axis=1)):
                    key = (k, ticker.dictionary[i].as_py())
                    held[key] = held[key] + sums[i] if key in held else sums[i]
            if len(held) * len(names) >= _HELD:
                yield from passed(held, known)
                held = {}
        yield from passed(held, known)

    def passed(held: dict, known: pa.Array) -> Iterator:
        for (k, who), v in held.items():
            on = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), k, np.int32)), pa.repeat(pa.scalar(who, pa.string()), len(on)), known.take(pa.array(on)), pa.array(v[on])], names=["k", "ticker", "term", "s"])

    seen = _spread(_known(docs.where("ticker IS NOT NULL"), dates).select("ticker", "q", "text")).withColumn("text", F.make_valid_utf8("text"))
    f = seen.mapInArrow(add, "k int, ticker string, term string, s double").groupBy("k", "ticker", "term").agg(F.sum("s").alias("s"))
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("k", "ticker")))
    return f.select(F.element_at(listed, F.col("k") + 1).alias("as_of"), "ticker", "term", (F.col("s") / norm).alias("value"))
