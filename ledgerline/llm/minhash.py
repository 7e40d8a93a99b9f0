"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each shingle is hashed once; the top bits of its hash choose a bin, which keeps its least hash. An empty bin takes the
value of another that a random order fixed for that bin names first among the full ones. The low-order bits of every
bin are packed; by chance two sets agree in 2^-bits of the rest, which the likeness takes out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import Words, arrow_schema, cut, documents, held_by, ship

BINS, BITS, SHINGLE = 512, 4, 5
_FIRST = 12  # columns of the order table that are tried before the whole
_SPREAD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprinter:
    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> None:
        assert bins & (bins - 1) == 0 and bits in (1, 2, 4, 8) and bins >= 8
        self.bins, self.bits, self.shingle = bins, bits, shingle
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        rng = np.random.default_rng(20170703)
        self.order = np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)
        self.factors = rng.integers(1, 2**63, shingle, dtype=np.uint64) | np.uint64(1)
        self.known = Words()

    def words(self, text: str | None) -> np.ndarray:
        """A hash for each word, lower-cased in A-Z."""
        import xxhash

        known, out = self.known, []
        for w in (text or "").encode("utf-8", "surrogatepass").lower().split():
            h = known.get(w)
            if h is None and (h := known.recall(w)) is None:
                h = xxhash.xxh64_intdigest(w, 7)
                known.keep(w, h)
            out.append(h)
        return np.array(out, np.uint64)

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """One hash a shingle; a text of fewer words is one shingle, an empty text too."""
        k = min(self.shingle, len(words)) or 1
        if not len(words):
            return _mix(np.array([self.factors[0]], np.uint64))
        n = len(words) - k + 1
        h = np.full(n, k * _SPREAD % 2**64, np.uint64)
        for i in range(k):
            h += words[i : i + n] * self.factors[i]
        return _mix(h)

    def of(self, words: np.ndarray) -> np.ndarray:
        """The packed fingerprint, as bytes."""
        return self.pack(self.least(np.sort(self.shingles(words))))

    def least(self, h: np.ndarray) -> np.ndarray:
        """The value of each bin, empty ones filled, of sorted hashes."""
        at = (h >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        value, full = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        value[at[first]], full[at[first]] = h[first], True
        empty = np.flatnonzero(~full)
        for order in (self.order[:, :_FIRST], self.order):
            if len(empty):
                hits = full[order[empty]]
                had = hits.any(axis=1)
                done = empty[had]
                value[done] = value[order[done, hits[had].argmax(axis=1)]]
                empty = empty[~had]
        return value

    def pack(self, value: np.ndarray) -> np.ndarray:
        """The low-order bits of the bins' values."""
        low = (value & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        return np.packbits(((low[:, None] >> np.arange(self.bits - 1, -1, -1, dtype=np.uint8)) & 1).ravel())

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        """Estimated Jaccard likeness of the shingle sets, without the agreement that chance gives."""
        same = np.unpackbits(a ^ b).reshape(self.bins, self.bits).any(axis=1)
        agree, chance = 1 - same.mean(), 2.0**-self.bits
        return float(min(1.0, max(0.0, (agree - chance) / (1 - chance))))


def _distinct_slots(spark: SparkSession, n: int) -> list[int]:
    """n numbers that a hash repartition into n parts sends to a part of their own each."""
    found: dict[int, int] = {}
    for r in spark.range(40 * n + 200).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("part")).groupBy("part").agg(F.min("id").alias("id")).collect():
        found[r.part] = r.id
    rest = (k for k in range(10**9, 10**9 + n))  # a part that none met shares another's
    return [found.get(p, next(rest)) for p in range(n)]


class _Ranges:
    """Buckets as ranges of (descending key, hash of the text); null keys follow in null_parts buckets by their hashes."""

    def __init__(self, bounds: list[tuple], null_parts: int) -> None:
        self.rising = sorted((d, -m) for d, m in bounds)
        self.null_parts = null_parts

    def bucket(self, key: object, mark: int) -> int:
        if key is None:
            return len(self.rising) + 1 + min(int((mark / 2.0**64 + 0.5) * self.null_parts), self.null_parts - 1)
        return len(self.rising) - bisect_left(self.rising, (key, -mark))


def _place_of(at, schema: str, make: Callable[[object, object, int], tuple]) -> Callable[[Column, Column], Column]:
    """A column of what make() says of a broadcast object, a key and a mark."""
    kinds = arrow_schema(schema)

    @F.arrow_udf(schema)
    def place(key: pa.Array, mark: pa.Array) -> pa.Array:
        held = at.value
        made = list(zip(*(make(held, k, m) for k, m in zip(key.to_pylist(), mark.to_pylist()))))
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(made, kinds)], fields=list(kinds))

    return place


def _bounds(rows: DataFrame, n: int, total: int) -> list[tuple]:
    """About n rows (key, mark) that split the rows with keys evenly; the driver gets no others.

    About 200 places a bucket are drawn by a hash, sorted by Spark, and every 200th of them is taken.
    """
    drawn = rows.select("doc_id", "mark").where(F.col("doc_id").isNotNull()).where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "mark", F.lit("bounds")), F.lit(1_000_000)) < F.lit(int(min(1e6, 2e8 * n / total)))).distinct()
    drawn = cut(drawn)
    every = max(1, drawn.count() // n)
    ranked = drawn.orderBy(F.col("doc_id").desc(), "mark").withColumn("at", F.monotonically_increasing_id() % F.lit(1 << 33))
    return [(r.doc_id, r.mark) for r in ranked.where((F.col("at") > 0) & (F.col("at") % every == 0)).select("doc_id", "mark").collect()]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Rows (bucket, copy, doc_id, mark, text) by which each bucket, sorted by descending key, holds its rows and the row that follows them.

    Buckets are ranges of (key, hash of the text), for keys of any kind that sorts; so rows that share a key are spread
    too. Only the first rows of each bucket come a second time (copy = 1), as the last of the bucket before; those of
    the first bucket follow the last bucket. Texts pass one shuffle, each bucket in a part of its own. The driver gets
    one bound and one first key for each bucket; executors search them by bisection.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    ship(spark)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    if not total:
        return rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("copy"), "doc_id", "mark", "text")
    ranges = sc.broadcast(_Ranges(_bounds(rows, n, total), max(1, -(-nulls * n // total))))
    known = rows.withColumn("bucket", _place_of(ranges, "bucket int", lambda r, k, m: (r.bucket(k, m),))(F.col("doc_id"), F.col("mark"))["bucket"])
    tops = known.select("doc_id", "mark", "bucket").groupBy("bucket").agg(F.max_by(F.struct("doc_id", "mark"), F.struct("doc_id", F.bitwise_not("mark"))).alias("top"))
    tops = sorted(((r.bucket, r.top.doc_id, r.top.mark) for r in tops.collect()), key=lambda t: t[0])
    slots = [*_distinct_slots(spark, n), *range(1_500_000_000, 1_500_000_000 + len(tops))]  # a few more buckets than parts share some of these, each with a number of its own
    here = {b: (slots[k], d, m, slots[(k or len(tops)) - 1]) for k, (b, d, m) in enumerate(tops)}
    places = sc.broadcast((ranges, here))

    def place(held: tuple, key: object, mark: int) -> tuple:
        b, d, m, before = held[1][held[0].value.bucket(key, mark)]
        return b, before if (d, m) == (key, mark) else None

    rows = rows.withColumn("place", _place_of(places, "bucket int, before int", place)(F.col("doc_id"), F.col("mark")))
    both = F.array(F.struct(F.col("place.bucket").alias("b"), F.lit(0).alias("c")), F.struct(F.col("place.before").alias("b"), F.lit(1).alias("c")))
    places = F.filter(both, lambda p: p["b"].isNotNull())
    return rows.withColumn("place", F.explode(places)).select(F.col("place.b").cast("int").alias("bucket"), F.col("place.c").alias("copy"), "doc_id", "mark", "text")


def edited(text: str, following: str) -> str:
    """text, with its last floor(n/2) code points replaced by the first as many (or all) of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is the one of the next lower key (of equal keys, the one whose text has the next greater hash;
    null keys are last); the first follows the last. A null text is empty. One document is its own next. An empty table
    gives none. Other columns are ignored, whatever their names.
    """
    rows = with_next(docs, key, text, buckets)
    kind = dict(rows.dtypes)["doc_id"]
    n = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "bucket").sortWithinPartitions(F.col("bucket"), F.col("copy"), F.col("doc_id").desc_nulls_last(), F.col("mark"), F.col("text"))
    rows = rows.select("bucket", "copy", "doc_id", "text")

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    kinds = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        fp = held_by(("minhash", bins, bits, shingle), lambda: Fingerprinter(bins, bits, shingle))
        held: tuple | None = None  # the row whose next is awaited: bucket, copy, doc_id, text, fingerprint

        def row(a: tuple, b: tuple) -> tuple:
            changed = edited(a[3], b[3])
            e = fp.of(fp.words(changed))
            return a[2], len(a[3]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), a[4].tobytes().hex(), e.tobytes().hex(), fp.likeness(a[4], e), fp.likeness(a[4], b[4])

        for batch in batches:
            out = []
            for bucket, copy, doc, t in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0] == bucket and held[1] == 1:
                    continue  # further copies: the first was the next
                now = (bucket, copy, doc, t, fp.of(fp.words(t)))
                if held and held[0] == bucket:
                    out.append(row(held, now))
                held = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds.field(k).type) for k, c in enumerate(zip(*out))], schema=kinds)

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))
