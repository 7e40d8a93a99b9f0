"""Quality by co-training: a text-content view and a page-metadata view teach each other, then score together.

The text view is a logistic regression over hashed word and shape features and the make-up of characters; the metadata
view is one over what is known of a document without looking into its text: language, source and length. In each
round either view labels the pool documents it is surest of, for the other to learn from. Both are calibrated on
documents held back from all of that, and a last regression combines the calibrated views.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import Words, affordable, arrow_schema, cut, documents, held_by, held_out, labelled_sample, learnt, released
from ledgerline.llm.toxicity import logistic

#: Documented bounds of what is learnt from: labelled documents of each class, documents of the unlabelled pool (which
#: is drawn from all kinds of documents, see pool_of), characters of all labelled ones (half of them for each
#: class; the pool has as many as a class) and of one document. A longer one teaches nothing, and the others as if it weren't there.
LABELLED, POOL, TRAIN_CHARS, ROW_CHARS = 1500, 2500, 24_000_000, 240_000
BUCKETS, MAKE_UP, META, ROUNDS, SURE, CALIBRATION = 1 << 16, 16, 80, 4, 0.9, 0.3
#: Share of the pool that each view may label of either class in one round.
PER_ROUND = 0.08
#: Metadata kinds (language, source, length) that the pool is drawn from evenly; rarer ones share a number by their hash.
KINDS = 512
_SHAPE = re.compile(r"(?P<A>[A-Z]+)|(?P<d>\d+)|(?P<a>[^\W\d_]+)")


def _token_features(token: str) -> tuple[int, int]:
    """Buckets of a token's word and of its shape (letters, capitals and digits as classes, other signs as they are)."""
    word = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % BUCKETS
    shape = _SHAPE.sub(lambda m: m.lastgroup, token)
    return word, zlib.crc32(b"shape " + shape.encode("utf-8", "surrogatepass")) % BUCKETS


class Reader:
    """Features of texts; those of tokens don't depend on a model, so a process keeps one table of them."""

    def text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sparse vector of a text: (buckets, values); words and shapes make a unit vector, the make-up follows them."""
        known = held_by("quality", Words)
        ids = []
        for t in text.split():
            f = known.get(t)
            if f is None and (f := known.recall(t)) is None:
                f = _token_features(t)
                known.keep(t, f)
            ids.extend(f)
        made = self.make_up(text)
        on = np.flatnonzero(made)
        if not ids:
            return BUCKETS + on, made[on]
        bucket, n = np.unique(np.array(ids), return_counts=True)
        value = 1 + np.log(n)
        return np.r_[bucket, BUCKETS + on], np.r_[value / np.sqrt((value**2).sum()), made[on]]

    @staticmethod
    def make_up(text: str) -> np.ndarray:
        """Shares of capitals, small letters, digits, blanks, line ends, signs and some single signs among a text's bytes."""
        out = np.zeros(MAKE_UP)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n = max(len(raw), 1)
        by = np.bincount(raw, minlength=256)
        sign = by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()
        out[:7] = by[65:91].sum() / n, by[97:123].sum() / n, by[48:58].sum() / n, by[32] / n, by[10] / n * 10, sign / n, by[128:].sum() / n
        out[7:13] = [by[ord(c)] / n * 10 for c in ",.|<{/"]
        return out

    @staticmethod
    def meta(length: int, lang: str | None, source: str | None) -> np.ndarray:
        """Dense vector of a document's metadata."""
        out = np.zeros(META)
        out[0] = np.log1p(length) / 10
        out[1 + min(int(length).bit_length(), 30)] = 1
        out[32 + zlib.crc32(f"lang {lang}".encode()) % 16] = 1
        out[48 + zlib.crc32(f"source {source}".encode()) % 32] = 1
        return out


@dataclass
class Sparse:
    """Rows of sparse vectors, for a logistic regression by full-batch Adam."""

    start: np.ndarray
    bucket: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        return Sparse(np.r_[0, np.cumsum([len(b) for b, _ in rows])], np.concatenate([b for b, _ in rows] or [np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([v for _, v in rows] or [np.zeros(0)]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        run = np.r_[0.0, np.cumsum(w[self.bucket] * self.value)]
        return run[self.start[1:]] - run[self.start[:-1]]

    def fit(self, y: np.ndarray, weight: np.ndarray, w: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> np.ndarray:
        """w: weights to begin with; the last is the bias. Rows of weight 0 don't count."""
        row = np.repeat(np.arange(len(y)), np.diff(self.start))
        m, v = np.zeros_like(w), np.zeros_like(w)
        weight = weight / weight.sum()
        for k in range(1, steps + 1):
            p = _sigmoid(self.dot(w[:-1]) + w[-1])
            d = weight * (p - y)
            g = np.r_[np.bincount(self.bucket, self.value * d[row], len(w) - 1), d.sum()] + ridge * np.r_[w[:-1], 0.0]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Views:
    """Both views' weights, their calibrations (slope, offset) and the combination (text, metadata, offset)."""

    text: np.ndarray
    meta: np.ndarray
    calibration: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    combination: tuple[float, float, float] = (1.0, 1.0, 0.0)
    reader: Reader = field(default_factory=Reader)

    def logits(self, text: str | None, lang: str | None, source: str | None) -> tuple[float, float]:
        """Calibrated logits of the two views."""
        b, v = self.reader.text(text or "")
        raw = (float(self.text[b] @ v + self.text[-1]), float(self.meta[:-1] @ self.reader.meta(len(text or ""), lang, source) + self.meta[-1]))
        return tuple(a * x + c for x, (a, c) in zip(raw, self.calibration))

    def score(self, text: str | None, lang: str | None, source: str | None) -> tuple[float, float, float]:
        """Probabilities by the text view, the metadata view and both."""
        t, m = self.logits(text, lang, source)
        a, b, c = self.combination
        return tuple(float(p) for p in _sigmoid(np.array([t, m, a * t + b * m + c])))


def co_train(taught: list[tuple], pool: list[tuple], held: list[tuple]) -> Views:
    """taught and held: (label, weight, text, lang, source); pool: (text, lang, source)."""
    views = Views(np.zeros(BUCKETS + MAKE_UP + 1), np.zeros(META + 1))
    y = np.array([r[0] for r in taught], float)
    if not 0 < y.sum() < len(y):
        views.text[-1] = views.meta[-1] = 4.0 if len(y) and y.all() else -4.0 if len(y) else 0.0
        return views
    reader, rows = views.reader, [r[2:] for r in taught] + list(pool)
    n = len(taught)
    sparse = Sparse.of([reader.text(t or "") for t, _, _ in rows])
    dense = np.stack([reader.meta(len(t or ""), lang, source) for t, lang, source in rows])
    label = {"text": np.r_[y, np.zeros(len(pool))], "meta": np.r_[y, np.zeros(len(pool))]}
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weight = {k: np.r_[balance, np.zeros(len(pool))] for k in label}
    for round_ in range(ROUNDS + 1):
        views.text = sparse.fit(label["text"], weight["text"], views.text, 150 if not round_ else 60)
        on = weight["meta"] > 0
        views.meta = logistic(dense[on], label["meta"][on], weight["meta"][on], ridge=1.0)
        if round_ == ROUNDS:
            break
        p = {"text": _sigmoid(sparse.dot(views.text[:-1]) + views.text[-1]), "meta": _sigmoid(dense @ views.meta[:-1] + views.meta[-1])}
        for teacher, learner in (("text", "meta"), ("meta", "text")):
            for one in (0, 1):  # the surest of either class, none below SURE, each document once
                sure = p[teacher] if one else 1 - p[teacher]
                free = np.flatnonzero((weight[learner] == 0) & (np.arange(len(rows)) >= n) & (sure >= SURE))
                best = free[np.argsort(-sure[free], kind="stable")[: int(np.ceil(PER_ROUND * len(pool)))]]
                label[learner][best], weight[learner][best] = one, 0.5
    if held and 0 < (hy := np.array([r[0] for r in held], float)).sum() < len(hy):
        hw = np.array([r[1] for r in held])
        raw = np.array([views.logits(*r[2:]) for r in held])
        fitted = [logistic(raw[:, [k]], hy, hw, ridge=1e-2) for k in (0, 1)]
        views.calibration = tuple((max(float(a), 0.0), float(b)) for a, b in fitted)
        both = np.array([views.logits(*r[2:]) for r in held])
        views.combination = tuple(map(float, logistic(both, hy, hw, ridge=1e-1)))
    return views


def pool_of(docs: DataFrame, key: str, text: str, lang: str, source: str, pool: int) -> DataFrame:
    """Rows (at, t, l, s) of at most pool documents that are not held out, as many as can be of each kind of metadata.

    All documents are read: each is of one of KINDS kinds by language, source and length, and the first of a kind by a
    hash of their keys are taken, so that rare kinds take part at every size of the corpus.
    """
    place = F.col("k").cast("string")
    rows = docs.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("l"), F.col(source).cast("string").alias("s"), F.coalesce(F.length(text), F.lit(0)).alias("n")).where(F.col("k").isNotNull() & ~held_out("k"))
    rows = rows.withColumn("kind", F.pmod(F.xxhash64("l", "s", F.length(F.bin("n"))), F.lit(KINDS))).withColumn("at", F.xxhash64(F.lit("pool"), place))
    counts = {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}  # at most KINDS rows
    if not counts:
        return docs.limit(0).select(F.lit(0).cast("long").alias("at"), F.col(text).alias("t"), F.lit("").alias("l"), F.lit("").alias("s"))
    share, left, todo = {}, pool, sorted(counts.values())
    for i, n in enumerate(todo):  # the level up to which every kind gives all it has
        share[n] = min(n, left // (len(todo) - i))
        left -= share[n]
    level = max(share.values())
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * level / n + 50 / n))]), F.col("kind"))
    near = rows.where(F.pmod(F.col("at"), F.lit(1_000_000)) / 1e6 < rate).select("k", "kind", "at").distinct()
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("at", "k"))).where(F.col("place") <= level)
    chosen = cut(first.orderBy("place", "at", "k").limit(pool).select("k", "at"))
    whole = docs.select(F.col(key).alias("k"), F.struct(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.col(source).cast("string").alias("s")).alias("d"))
    return whole.join(F.broadcast(chosen), "k").groupBy("k", "at").agg(F.min("d").alias("d")).select("at", "d.*")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", lang: str = "lang", source: str = "source", labelled: int = LABELLED, pool: int = POOL, train_chars: int = TRAIN_CHARS, row_chars: int = ROW_CHARS) -> Views:
    """Learns from at most labelled documents of each class and at most pool others, none of them held out, chosen by a hash of the key.

    All of it runs in one task, whose input the bounds limit; the driver gets the views alone. A key with several labels
    has the lowest, one with several rows the least; null labels are left out, as is a text of more than row_chars or than
    what is left of its class's half of train_chars; of a class without any other text the shortest is thinned to that. Without
    documents of both classes every score is the same. Other columns are ignored, whatever their names.
    """
    sample = labelled_sample(docs, labels, key, label, {"t": text, "l": lang, "s": source}, labelled, "quality", F.min)
    sample = sample.select(F.lit(0).alias("part"), F.monotonically_increasing_id().alias("at"), "y", "weight", "calibrates", "t", F.col("l").cast("string").alias("l"), F.col("s").cast("string").alias("s"))
    others = pool_of(docs, key, text, lang, source, pool).select(F.lit(1).alias("part"), "at", F.lit(None).cast("int").alias("y"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("calibrates"), "t", "l", "s")
    both = sample.unionByName(others).repartition(1).sortWithinPartitions("part", "at")

    def learn(rows: Iterator[tuple]) -> dict:
        taught, held, unlabelled = [], [], []
        for part, _, y, weight, calibrates, *d in affordable(rows, 5, lambda r: r[2], train_chars // 2, row_chars):  # the pool has no label
            if part:
                unlabelled.append(tuple(d))
            else:
                (held if calibrates < CALIBRATION else taught).append((y, weight, *d))
        v = co_train(taught, unlabelled, held)
        return {"text": v.text.tobytes(), "meta": v.meta.tobytes(), "numbers": [float(x) for x in (*v.calibration[0], *v.calibration[1], *v.combination)]}

    got = learnt(both, learn, "text binary, meta binary, numbers array<double>")
    if not got:
        return co_train([], [], [])
    a, b, c, d, *combination = got.numbers
    return Views(np.frombuffer(got.text), np.frombuffer(got.meta), ((a, b), (c, d)), tuple(combination))


def classify(docs: DataFrame, views: Views, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, text_score, meta_score, score (0 to 1, higher: better), predicted (1 if score >= 0.5) for every row.

    A null text is empty; a null language or source is a value of its own. Rows are independent: repeated rows and null
    keys are as any other.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, text_score double, meta_score double, score double, predicted int"
    kinds, sent = arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                p = np.array([sent.value.score(*r) for r in zip(*(c.to_pylist() for c in b.columns[1:]))])
                yield pa.RecordBatch.from_arrays([b.column(0).cast(kinds.field(0).type), *(pa.array(p[:, k]) for k in range(3)), pa.array((p[:, 2] >= 0.5).astype(np.int32))], schema=kinds)

    return rows.mapInArrow(lambda batches: released(run(batches)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "text_score", "meta_score", "score", "predicted")
