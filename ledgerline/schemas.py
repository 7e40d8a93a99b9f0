"""Schemas of the stored tables, and the checks a scan makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("ticker", "string"), ("date", "date"), ("open", "double"), ("high", "double"), ("low", "double"), ("close", "double"), ("volume", "double"))]})
EMBEDDINGS = "ticker string, doc_date date, doc_type string, embedding array<float>, norm double, n_chunks int"
FILINGS_INDEX = "ticker string, cik string, year int, word_count long, char_count long, filed_date string"
TRANSCRIPTS_INDEX = "ticker string, year int, quarter int, date string, char_count long"
NEWS = "text string, date string, extra_fields string"


def validate(df: DataFrame, required: list[str], what: str = "table") -> DataFrame:
    """df, if it has all required columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}; it has {df.columns}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in every float column: aggregates here skip null but not NaN."""
    return df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
