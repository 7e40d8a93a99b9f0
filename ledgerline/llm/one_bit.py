"""Nearest neighbours by randomly rotated one-bit codes.

A vector's offset from the centre is rotated at random and only the signs are kept, packed, with two numbers: the
offset's length and the inner product of its direction with that of its code. From these a query's inner product with
the vector is estimated without bias, and the error has a bound that holds but for a probability falling like exp(-EPSILON^2).
Rows whose least possible distance is above the k-th distance found so far are passed over; all others are reranked by
exact distances in double precision, ties included. No list is cut short: each query meets every code.

The index is spread over the cluster and never moves again; queries go to it in groups of about QUERY_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_schema, cut, released, ship

#: The bound's width in standard deviations, about; measured recall is in the README.
EPSILON = 3.0
#: Rows (about) from which the centre is fitted: any point gives right results, one near the middle gives tighter bounds.
CENTRE_ROWS = 10_000
#: Bytes of vectors that a group of queries and a part of the index hold, about; rows of a part, where that makes more parts.
QUERY_BYTES, PART_BYTES, PART_ROWS = 32 << 20, 32 << 20, 4096
SEED = 20240527
_ROWS, _QUERIES, _PAIRS = 2048, 512, 1 << 16
_LAST = np.iinfo(np.int64).max


def _usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


class Coder:
    """Codes and estimates for vectors of one size."""

    def __init__(self, centre: np.ndarray, seed: int = SEED) -> None:
        self.centre, self.turn = centre, rotation(len(centre), seed)

    def offsets(self, v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return (v - self.centre) @ self.turn.T

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, lengths of the offsets, and inner products of the offsets' directions with those of their codes."""
        o = self.offsets(v)
        bits = o > 0
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            length = np.sqrt((o * o).sum(axis=1))
            agreement = np.abs(o).sum(axis=1) / (length * np.sqrt(o.shape[1]))
        agreement[~(length > 0)] = 1.0
        return np.packbits(bits, axis=1), length, agreement

    def bounds(self, packed: np.ndarray, length: np.ndarray, agreement: np.ndarray, q: np.ndarray, q_length: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of each query (row) to each code (column), q being the queries' offsets in float32."""
        size = q.shape[1]
        signs = np.unpackbits(packed, axis=1, count=size).astype(np.float32) * 2 - 1
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            scale = (2 * length / (agreement * np.sqrt(size))).astype(np.float32)
            cross = (q @ signs.T) * scale
            spread = np.sqrt(np.maximum(0.0, 1 - agreement**2)) / agreement * epsilon / np.sqrt(max(1, size - 1))
            rounding = 1e-5 * (length + 1) ** 2
            around = q_length[:, None].astype(np.float32) * (2 * length * spread).astype(np.float32) + (rounding + 1e-5 * (q_length[:, None] + 1) ** 2).astype(np.float32)
            middle = (length**2).astype(np.float32) + (q_length[:, None] ** 2).astype(np.float32) - cross
            return middle - around, middle + around


class Search:
    """The nearest rows found so far for a group of queries."""

    def __init__(self, coder: Coder, uid: np.ndarray, vectors: np.ndarray, k: int, epsilon: float) -> None:
        self.coder, self.uid, self.vectors, self.k, self.epsilon = coder, uid, vectors, k, epsilon
        o = coder.offsets(vectors)
        with np.errstate(over="ignore", invalid="ignore"):
            self.q, self.length = o.astype(np.float32), np.sqrt((o * o).sum(axis=1))
        n = len(uid)
        self.distance = np.full((n, k), np.inf)
        self.rank = np.full((n, k), _LAST)  # ids, null ones last
        self.null = np.ones((n, k), bool)
        self.found = np.zeros(n, np.int64)
        self.reranked = 0

    def meet(self, uid: np.ndarray, ids: np.ndarray, null: np.ndarray, vectors: np.ndarray, packed: np.ndarray, length: np.ndarray, agreement: np.ndarray) -> None:
        for at in range(0, len(self.uid), _QUERIES):
            here = slice(at, at + _QUERIES)
            low, high = self.coder.bounds(packed, length, agreement, self.q[here], self.length[here], self.epsilon)
            most = np.where(self.found[here] >= self.k, self.distance[here, -1], np.inf) ** 2
            if len(uid) > self.k:  # one of these may be the query's own row
                most = np.fmin(most, np.partition(np.where(np.isnan(high), np.inf, high), self.k, axis=1)[:, self.k])
            with np.errstate(invalid="ignore"):
                query, row = np.nonzero(~(low > (most * (1 + 1e-5))[:, None]))  # what can't be compared is reranked
            own = self.uid[at + query] == uid[row]
            query, row = query[~own] + at, row[~own]
            for p in range(0, len(query), _PAIRS):
                self._keep(query[p : p + _PAIRS], row[p : p + _PAIRS], ids, null, vectors)

    def _keep(self, query: np.ndarray, row: np.ndarray, ids: np.ndarray, null: np.ndarray, vectors: np.ndarray) -> None:
        """Exact distances of these pairs, and the k nearest of old and new; query is sorted."""
        self.reranked += len(query)
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.sqrt(((vectors[row] - self.vectors[query]) ** 2).sum(axis=1))
        d[np.isnan(d)] = np.inf
        which = np.unique(query)
        old_q = np.repeat(which, self.k)
        held = (np.arange(self.k) < self.found[which][:, None]).ravel()
        q = np.r_[old_q[held], query]
        d = np.r_[self.distance[which].ravel()[held], d]
        i = np.r_[self.rank[which].ravel()[held], np.where(null[row], _LAST, ids[row])]
        z = np.r_[self.null[which].ravel()[held], null[row]]
        order = np.lexsort((i, z, d, q))
        q, d, i, z = q[order], d[order], i[order], z[order]
        first = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1]
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        near = place < self.k
        q, d, i, z, place = q[near], d[near], i[near], z[near], place[near]
        self.distance[q, place], self.rank[q, place], self.null[q, place] = d, i, z
        self.found[which] = np.bincount(q, minlength=len(self.uid))[which]


def _matrix(column, size: int) -> np.ndarray:
    """A list column without nulls, as rows."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


def build_index(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Coder | None]:
    """The index of all usable rows (uid, id, vector, bits, length, agreement), written, and its coder; None if there are none.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another size than
    the most frequent one (of two as frequent, the lesser). Keys are integers and may repeat or be null: each row is one.
    """
    spark = rows.sparkSession
    ship(spark)
    v = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where(_usable(F.col("vector")))
    sizes = v.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "uid long, id long, vector array<double>, bits binary, length double, agreement double"
    if sizes is None:
        return spark.createDataFrame([], schema), None
    size, n = sizes.size, sizes["count"]
    parts = max(-(-n * size * 8 // PART_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_ROWS)))
    v = v.where(F.size("vector") == size).select("id", F.col("vector").cast("array<double>").alias("vector"))
    v = cut(v.repartition(parts).withColumn("uid", F.monotonically_increasing_id()))
    sample = v.where(F.pmod(F.xxhash64("uid"), F.lit(1_000_000)) < int(min(1e6, 1e6 * CENTRE_ROWS / n + 1)))
    means = dict(sample.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.avg("x")).collect())  # one row a component
    centre = np.array([means.get(k, 0.0) for k in range(size)])
    centre[~np.isfinite(centre)] = 0.0
    coder = Coder(centre)
    sent, kinds = spark.sparkContext.broadcast(coder), arrow_schema(schema)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                bits, length, agreement = sent.value.encode(_matrix(b.column("vector"), size))
                yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("id"), b.column("vector").cast(kinds.field(2).type), pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(length), pa.array(agreement)], schema=kinds)

    return cut(v.mapInArrow(lambda batches: released(encode(batches)), schema)), coder


def _scan(index: DataFrame, queries: DataFrame, coder: Coder, k: int, epsilon: float) -> DataFrame:
    """Each part's k nearest for each of the queries (a group within QUERY_BYTES): q_uid, query_id, id, score."""
    spark, size = index.sparkSession, len(coder.centre)
    got = queries.select("uid", "id", "vector").toArrow().combine_chunks()
    group = (got["uid"].to_numpy(), got["id"].to_numpy(), _matrix(got["vector"].combine_chunks(), size) if got.num_rows else np.zeros((0, size)))
    sent = spark.sparkContext.broadcast((coder, *group))
    schema = "q_uid long, query_id long, id long, score double"
    kinds = arrow_schema(schema)

    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= _ROWS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder, uid, ids, vectors = sent.value
        search = Search(coder, uid, vectors, k, epsilon)
        for t in blocks(batches):
            bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
            near = t["id"]
            search.meet(t["uid"].to_numpy(), near.fill_null(0).to_numpy(), near.is_null().to_numpy(), _matrix(t["vector"].combine_chunks(), size), bits, t["length"].to_numpy(), t["agreement"].to_numpy())
        q, place = np.nonzero(np.arange(k) < search.found[:, None])
        for at in range(0, len(q), 100_000):
            x, p = q[at : at + 100_000], place[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(uid[x]), pa.array(ids[x]), pa.array(search.rank[x, p], mask=search.null[x, p]), pa.array(search.distance[x, p])], schema=kinds)

    return index.select("uid", "id", "vector", "bits", "length", "agreement").mapInArrow(lambda batches: released(run(batches)), schema)


def nearest(index: DataFrame, coder: Coder | None, queries: Column, k: int = 10, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of the index for each of its rows that queries (a condition on id) chooses.

    A query's own row is no candidate; other rows with its key or vector are. Ties go to the smaller id, null ids last.
    Rows that repeat a query's key are queries of their own. Fewer candidates than k give fewer rows.
    """
    spark = index.sparkSession
    if coder is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = index.where(F.coalesce(queries, F.lit(False)))
    groups = max(1, -(-chosen.count() * len(coder.centre) * 8 // QUERY_BYTES))
    found = None
    for g in range(groups):  # a group is a fixed amount of queries, and each meets the whole index in place
        part = _scan(index, chosen.where(F.pmod(F.xxhash64("uid"), F.lit(groups)) == g), coder, k, epsilon)
        best = part.withColumn("rank", F.row_number().over(Window.partitionBy("q_uid").orderBy("score", F.col("id").asc_nulls_last()))).where(F.col("rank") <= k)
        best = best.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
        best = cut(best) if groups > 1 else best
        found = best if found is None else found.unionByName(best)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, coder = build_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(index, coder, F.col("id") % 100 == 0)


#: Brute force; the search equals it where no error bound fails.
SQL = """
WITH v AS (SELECT vec_id, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
           FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
