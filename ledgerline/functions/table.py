"""Table functions for SQL: texts as chunks, articles as the words that may be tickers.

    register(spark)
    SELECT d.doc_id, c.* FROM docs d, LATERAL chunk_text(d.text, max_tokens => 256) c
    SELECT n.id, w.ticker FROM news n, LATERAL ticker_words(n.text, n.extra_fields) w JOIN tickers USING (ticker)
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ledgerline.operators import text
from ledgerline.session import ship


def _texts(name: str, **arguments: AnalyzeArgument | None) -> None:
    for k, a in arguments.items():
        if a is not None and (a.isTable or not isinstance(a.dataType, StringType)):
            raise ValueError(f"{name}: {k} must be a string, not {'a table' if a.isTable else a.dataType.simpleString()}")


class ChunkText:
    """(chunk_no, chunk) of a text: sentences packed into chunks of about max_tokens (a constant; 512). A null text has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, max_tokens: AnalyzeArgument | None = None) -> AnalyzeResult:
        _texts("chunk_text", text=text)
        if max_tokens is not None and (not max_tokens.isConstantExpression or not isinstance(max_tokens.value, int) or max_tokens.value < 1):
            raise ValueError("chunk_text: max_tokens must be a constant above 0")
        return AnalyzeResult(StructType().add("chunk_no", IntegerType()).add("chunk", StringType()))

    def eval(self, text: str | None, max_tokens: int = 512) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(_chunk_text(text, max_tokens))


class TickerWords:
    """(ticker, origin) of an article: what its tags name (origin tag), and the words of three letters or more in its title (origin title)."""

    @staticmethod
    def analyze(text: AnalyzeArgument, extra_fields: AnalyzeArgument | None = None) -> AnalyzeResult:
        _texts("ticker_words", text=text, extra_fields=extra_fields)
        return AnalyzeResult(StructType().add("ticker", StringType()).add("origin", StringType()))

    def eval(self, text: str | None, extra_fields: str | None = None) -> Iterator[tuple[str, str]]:
        yield from ((x, "tag") for x in tag_words(extra_fields))
        title = (text or "").split("\n\n")[0] if "\n\n" in (text or "") else (text or "")[:200]
        yield from ((x, "title") for x in sorted({w for w in title.upper().split(" ") if len(w) >= 3}))


_chunk_text = text.chunk_text


def tag_words(extra: str | None) -> list[str]:
    """The ticker-like entries of the JSON list `stocks`, as operators.text.tags() finds them."""
    try:
        stocks = json.loads(extra or "{}").get("stocks")
    except (ValueError, AttributeError):
        return []
    cleaned = {s.upper().strip("$").strip(" ") for s in stocks if isinstance(s, str)} if isinstance(stocks, list) else set()
    return sorted(s for s in cleaned if 0 < len(s) <= 6 and " " not in s and s not in text.INDEX_TICKERS)


def register(spark: SparkSession) -> None:
    """Makes chunk_text and ticker_words callable from SQL in this session."""
    ship(spark)
    spark.udtf.register("chunk_text", udtf(ChunkText))
    spark.udtf.register("ticker_words", udtf(TickerWords))
