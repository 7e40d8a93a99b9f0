"""Document encoders: chunks to vectors to one vector a document. The encoder is pluggable; the default hashes words."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.vectors import norm
from ledgerline.operators.text import chunk_pieces, chunk_text

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 768) -> Encoder:
    """Signed hashed word counts, unit length: deterministic and free of a model."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, t in zip(out, texts):
            h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in t.lower().split()], np.uint32)
            row[:] = np.bincount(h % dim, np.where(h & 0x80000000, 1.0, -1.0), dim)
            n = np.linalg.norm(row)
            if n > 0:
                row /= n
        return out

    return encode


#: Documents whose sums a task passes on at once.
_ROWS = 512


def embed_documents(docs: DataFrame, key: list[str], encoder: Encoder | None = None, dim: int = 768, max_tokens: int = 512, batch: int = 64) -> DataFrame:
    """(key, embedding, norm, n_chunks): mean of the unit vectors of a document's chunks, not normalised; zeros without chunks.

    A document is cut, encoded and added up in the task that reads it; one sum a row of docs travels, not a row for each
    of its numbers. Rows of one key are one document's, and each of them gets its mean.
    """
    import pyarrow as pa

    encoder = encoder or hashing_encoder(dim)
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "s array<double>", "n long"])

    def run(batches):  # noqa: ANN001, ANN202
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                sums, n, held, of = np.zeros((b.num_rows, dim)), np.zeros(b.num_rows, np.int64), [], []

                def add():  # noqa: ANN202
                    np.add.at(sums, of, np.asarray(encoder(held), np.float64))
                    np.add.at(n, of, 1)

                for row in range(b.num_rows):
                    text = b.column(len(key))[row].as_py()
                    for c in [] if text is None else chunk_text(text, max_tokens):
                        held.append(c)
                        of.append(row)
                        if len(held) == batch:
                            add()
                            held, of = [], []
                if held:
                    add()
                listed = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dim), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(key))), listed, pa.array(n)], names=[*key, "s", "n"])

    parts = docs.select(*key, "text").mapInArrow(run, schema)
    d = parts.groupBy(*key).agg(F.collect_list("s").alias("parts"), F.sum("n").cast("int").alias("n_chunks"))
    total = F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(F.aggregate("parts", F.array_repeat(F.lit(0.0), dim), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)))
    d = d.select(*key, F.transform(total, lambda x: (x / F.greatest(F.col("n_chunks"), F.lit(1))).cast("float")).alias("embedding"), "n_chunks", F.size("parts").alias("rows"))
    d = d.withColumn("norm", norm(F.col("embedding")))
    return d.withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(*key, "embedding", "norm", "n_chunks")


def embed_pieces(rows: DataFrame, key: list[str], order: list[str], encoder: Encoder | None = None, dim: int = 768, max_tokens: int = 512, batch: int = 64) -> DataFrame:
    """(key, embedding, norm, n_chunks) of the documents that rows (key, order, text) joined in order are, as embed_documents() has them.

    A document's rows stream through one task, which holds a row and a batch of chunks: no row has to hold a document.
    """
    import pyarrow as pa

    encoder = encoder or hashing_encoder(dim)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "embedding array<float>", "n_chunks int"])

    def run(batches):  # noqa: ANN001, ANN202
        from itertools import batched, groupby

        flat = ((b, i) for b in batches for i in range(b.num_rows))
        for _, group in groupby(flat, key=lambda r: tuple(r[0].column(k)[r[1]].as_py() for k in range(len(key)))):
            first, at = next(group)
            pieces = (r.column(len(key))[i].as_py() or "" for g in ([(first, at)], group) for r, i in g)
            total, n = np.zeros(dim), 0
            for held in batched(chunk_pieces(pieces, max_tokens), batch):
                total += np.asarray(encoder(list(held)), np.float64).sum(axis=0)
                n += len(held)
            mean = pa.array([(total / max(n, 1)).astype(np.float32)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(first.column(k).slice(at, 1) for k in range(len(key))), mean, pa.array([n], pa.int32())], names=[*key, "embedding", "n_chunks"])

    ordered = rows.repartition(*key).sortWithinPartitions(*key, *order).select(*key, "text")
    return ordered.mapInArrow(run, schema).select(*key, "embedding", norm(F.col("embedding")).alias("norm"), "n_chunks")
