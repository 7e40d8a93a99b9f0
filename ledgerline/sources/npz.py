"""Embedding stores that numpy wrote: one .npz archive a ticker, with embeddings, dates and (in newer ones) norms and n_chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import empty_files, ship

_SCHEMA = "path string, doc_date date, embedding array<float>, norm double, n_chunks int, error string"


def decoded(content: bytes, dim: int | None = None) -> list[tuple]:
    """(doc_date, embedding, norm, n_chunks) of an archive's documents; ValueError says what is wrong with it. No pickled objects are read."""
    import io
    import zipfile
    import zlib
    from datetime import date

    try:
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            held = {k: z[k] for k in z.files}
    except (ValueError, OSError, EOFError, KeyError, zipfile.BadZipFile, zlib.error) as e:
        raise ValueError(f"no readable archive: {e}"[:300]) from e
    for k in ("embeddings", "dates"):
        if k not in held:
            raise ValueError(f"lacks {k}")
    v, days = held["embeddings"], held["dates"]
    if v.ndim != 2:
        raise ValueError(f"embeddings have {v.ndim} dimensions, not 2")
    if v.dtype.kind not in "fiu":
        raise ValueError(f"embeddings are {v.dtype}, no numbers")
    if dim is not None and v.shape[1] != dim:
        raise ValueError(f"embeddings have {v.shape[1]} components, not {dim}")
    for k in ("dates", "norms", "n_chunks"):
        if k in held and held[k].shape != (len(v),):
            raise ValueError(f"{len(v)} embeddings, but {k} of shape {held[k].shape}")
    if not np.isfinite(v.astype(np.float64)).all():
        raise ValueError("embeddings hold values that are not finite")
    norms = np.linalg.norm(v.astype(np.float64), axis=1)
    if "norms" in held:
        if held["norms"].dtype.kind not in "fiu" or not np.allclose(held["norms"].astype(np.float64), norms, rtol=1e-3, atol=1e-6):
            raise ValueError("norms aren't those of the embeddings")
        norms = held["norms"].astype(np.float64)
    chunks = held.get("n_chunks", np.ones(len(v), int))
    if chunks.dtype.kind not in "iu":
        raise ValueError(f"n_chunks are {chunks.dtype}, no integers")
    return [(date.fromisoformat(str(d)[:10]), x, n, int(c)) for d, x, n, c in zip(days, v.astype(np.float32), norms.tolist(), chunks)]


def decode_npz(files: DataFrame, dim: int | None = None) -> DataFrame:
    """(path, doc_date, embedding, norm, n_chunks, error) of files (path, content): a row a document, or one row with the error of a file that isn't whole."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import ArrayType, DateType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

        kinds = to_arrow_schema(StructType([StructField("path", StringType()), StructField("doc_date", DateType()), StructField("embedding", ArrayType(FloatType())), StructField("norm", DoubleType()), StructField("n_chunks", IntegerType()), StructField("error", StringType())]))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    rows = [(path, d, x.tolist(), n, c, None) for d, x, n, c in decoded(content.as_py() or b"", dim)]
                except ValueError as e:
                    rows = [(path, None, None, None, None, str(e))]
                for at in range(0, len(rows), 500):
                    yield batch(rows[at : at + 500])

    return files.select("path", "content").mapInArrow(run, _SCHEMA)


def read_npz(spark: SparkSession, path: str, doc_type: str, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(embeddings as the embedding store has them, files that are broken as (path, error)) of all .npz files below path; the ticker is the file's name.

    Files are read in parallel, and none is dropped: a file with any fault gives no embeddings and one row of the second table.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path)
    rows = decode_npz(files, dim)
    # a scan passes over files without a byte, so the listing names them
    empty = spark.createDataFrame([(p, "no readable archive: empty file") for p in empty_files(spark, path, ".npz")], "path string, error string")
    good = rows.where("error IS NULL").select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("ticker"), "doc_date", F.lit(doc_type).alias("doc_type"), "embedding", "norm", "n_chunks")
    return good, rows.where("error IS NOT NULL").select("path", "error").unionByName(empty)


def packed(docs: DataFrame) -> DataFrame:
    """(path, content): each ticker's (doc_date, embedding, norm, n_chunks) as an archive in order of date; what decode_npz reads."""

    def pack(rows):  # noqa: ANN001, ANN202
        import io

        import pandas as pd

        rows = rows.sort_values(["doc_date", "norm"], kind="stable")
        out = io.BytesIO()
        np.savez_compressed(out, embeddings=np.stack(list(rows["embedding"])), dates=np.array([str(d)[:10] for d in rows["doc_date"]]), norms=rows["norm"].to_numpy(), n_chunks=rows["n_chunks"].to_numpy())
        return pd.DataFrame({"path": [f"{rows['ticker'].iloc[0]}.npz"], "content": [out.getvalue()]})

    return docs.groupBy("ticker").applyInPandas(pack, "path string, content binary")
