"""Text preparation: cleaning, counting, chunking, tags, deduplication, concatenation, resumable work."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marked fixed values: the section marks of an annual report, in order of preference, and the signs of a clean or tagged start.
SECTIONS = (r"\bPART\s+I\b", r"\bItem\s+1[\.\s]", r"UNITED\s+STATES\s+SECURITIES\s+AND\s+EXCHANGE\s+COMMISSION", r"\bFORM\s+10-K\b")
CLEAN = r"(Item\s+1|PART\s+I|UNITED\s+STATES|FORM\s+10-K|ANNUAL\s+REPORT)"
TAGGED = r"(fasb\.org|xbrl|false\d{4}FY|\.htm\b|0{6,}\d+\n|--\d{2}-\d{2}\nFY)"
PROSE = r"(?s)[A-Z][a-z].{198,}"
#: Fixed value: names of indices that are no tickers.
INDEX_TICKERS = ("$INDU", "$SPX", "$COMP", "$DJI", "$NDX", "$VIX", "INDU", "SPX", "COMP", "DJI", "NDX", "VIX")
#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Inc", "Corp", "Co", "Ltd", "No", "vs", "etc", "U.S", "e.g", "i.e", "Jr", "Sr", "St", "Fig", "Sec")


def word_count(text: Column) -> Column:
    """Runs of non-white space (Unicode's)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def _flags(pattern: str) -> str:
    return f"(?iU){pattern}"


def narrative_start(text: Column) -> Column:
    """Place (from 1) of the first section mark, 0 without any: the second hit of a mark whose first is within the first fifth."""
    out = F.regexp_instr(text, F.lit(PROSE))
    for pattern in reversed(SECTIONS):
        p = _flags(pattern)
        first = F.regexp_instr(text, F.lit(p))
        hit = F.regexp_extract(text, p, 0)
        rest = F.substring(text, first + F.length(hit), F.length(text))
        # the rest loses the mark before it, which a word boundary may look at; a stand-in keeps that sight
        seen = F.concat(F.right(hit, F.lit(1)), rest)
        second = F.regexp_instr(seen, F.lit(p))
        place = F.when((second > 0) & (first - 1 < F.length(text) * 0.2), first + F.length(hit) + second - 2).otherwise(first)
        out = F.when(first > 0, place).otherwise(out)
    return out


def clean_filing(text: Column) -> Column:
    """text from its narrative start on; unchanged if its first 500 characters look clean."""
    head = F.left(text, F.lit(500))
    clean = head.rlike(_flags(CLEAN)) & ~head.rlike(_flags(TAGGED))
    at = narrative_start(text)
    return F.when(clean | text.isNull() | (at <= 1), text).otherwise(F.substring(text, at, F.length(text)))


def clean_index(index: DataFrame, texts: DataFrame, least_words: int = 2000) -> DataFrame:
    """index without duplicates of (ticker, year) (most words stay), with counts of the cleaned texts, enough words only."""
    best = F.row_number().over(Window.partitionBy("ticker", "year").orderBy(F.col("word_count").desc(), "cik"))
    i = index.withColumn("_best", best).where(F.col("_best") == 1).drop("_best")
    t = texts.select("ticker", "year", clean_filing(F.col("text")).alias("_t"))
    i = i.join(t, ["ticker", "year"]).withColumns({"word_count_clean": word_count(F.col("_t")).cast("long"), "char_count_clean": F.length("_t").cast("long")}).drop("_t")
    return i.where(F.col("word_count_clean") >= least_words)


#: The end of a sentence, and what may become one when text follows.
_END, _OPEN_END = re.compile(r"[.!?][\"')\]]*\s+(?=[\"'(\[]?[A-Z0-9])"), re.compile(r"[.!?][\"')\]]*\s*[\"'(\[]?\Z")


def _abbreviated(text: str, start: int, end: int) -> bool:
    before = text[start:end].rsplit(None, 1)
    return text[end] == "." and bool(before) and (before[-1].lstrip("(\"'") in ABBREVIATIONS or bool(re.fullmatch(r"[A-Z]", before[-1])))


def sentences(text: str) -> list[str]:
    """Sentences by their closing sign and a following capital; common abbreviations don't end one."""
    out, start = [], 0
    for m in _END.finditer(text):
        if _abbreviated(text, start, m.start()):
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    tail = text[start:].strip()
    return [*out, tail] if tail else out


def chunk_text(text: str, max_tokens: int = 512, chars_per_token: float = 3.5) -> list[str]:
    """Sentences packed into chunks of about max_tokens; a short text is one chunk, chunks of 50 characters or fewer go."""
    most = int(max_tokens * chars_per_token)
    return [text] if len(text) <= most else [c for c in _packed(sentences(text), most) if len(c.strip()) > 50]


def chunk_pieces(pieces: Iterable[str], max_tokens: int = 512, chars_per_token: float = 3.5) -> Iterator[str]:
    """chunk_text() of the pieces joined, which are never held at once: one piece, an open sentence and an open chunk are."""
    most, head, pieces = int(max_tokens * chars_per_token), "", iter(pieces)
    for p in pieces:
        head += p
        if len(head) > most:
            yield from (c for c in _packed(_flowing(chain([head], pieces)), most) if len(c.strip()) > 50)
            return
    yield head


def _packed(found: Iterable[str], most: int) -> Iterator[str]:
    held, size = [], 0
    for s in found:
        if held and size + len(s) > most:
            yield " ".join(held)
            held, size = [], 0
        held.append(s)
        size += len(s)
    if held:
        yield " ".join(held)


def _flowing(pieces: Iterable[str]) -> Iterator[str]:
    """sentences() of the pieces joined; an end that the next piece may still decide is looked at again with it."""
    text, scanned = "", 0
    for p in pieces:
        text, start = text + p, 0
        for m in _END.finditer(text, scanned):
            if not _abbreviated(text, start, m.start()):
                yield text[start : m.end()].strip()
                start = m.end()
            scanned = m.end()
        open_end = _OPEN_END.search(text, scanned)
        text, scanned = text[start:], (open_end.start() if open_end else len(text)) - start
    if text.strip():
        yield text.strip()


#: Characters of chunks that a task holds before it passes them on.
_CHUNK_CHARS = 1 << 20


def chunks(docs: DataFrame, key: list[str], text: str = "text", max_tokens: int = 512) -> DataFrame:
    """(key, chunk_no, chunk) rows of all documents. A task holds one text and about _CHUNK_CHARS of chunks beside the batch it reads."""
    import pyarrow as pa

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "chunk_no int", "chunk string"])
    narrow = docs.select(*key, F.col(text).alias("_text")).where("_text IS NOT NULL")

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows, numbers, held, size = [], [], [], 0

            def passed():  # noqa: ANN202
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(len(key))), pa.array(numbers, pa.int32()), pa.array(held, pa.string())], names=[*key, "chunk_no", "chunk"])

            for row in range(b.num_rows):
                for number, c in enumerate(chunk_text(b.column(len(key))[row].as_py(), max_tokens)):
                    rows.append(row)
                    numbers.append(number)
                    held.append(c)
                    size += len(c)
                    if size >= _CHUNK_CHARS:
                        yield passed()
                        rows, numbers, held, size = [], [], [], 0
            if held:
                yield passed()

    return narrow.mapInArrow(run, schema)


def dedup_key(text: Column, date: Column) -> Column:
    return F.md5(F.concat(F.lower(F.left(text, F.lit(80))), F.lit("|"), F.date_format(date, "yyyy-MM-dd")))


def parse_date(s: Column, first: str = "2000-01-01", last: str = "2025-12-31") -> Column:
    """ISO date in the first ten characters, null if there is none or it is out of range."""
    d = F.when(F.left(s, F.lit(10)).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.left(s, F.lit(10)), "yyyy-MM-dd"))
    return F.when(d.between(F.lit(first).cast("date"), F.lit(last).cast("date")), d)


def tags(extra: Column) -> Column:
    """Distinct ticker-like entries of the JSON list `stocks`, sorted: upper case, no $, no index, at most 6 characters, no space."""
    listed = F.from_json(extra, "stocks array<string>")["stocks"]
    cleaned = F.transform(listed, lambda x: F.trim(F.regexp_replace(F.upper(x), r"^\$+|\$+$", "")))
    kept = F.filter(cleaned, lambda x: x.isNotNull() & (F.length(x) <= 6) & (F.length(x) > 0) & ~x.contains(" ") & ~x.isin(*INDEX_TICKERS))
    return F.array_sort(F.array_distinct(F.coalesce(kept, F.array().cast("array<string>"))))


def title(text: Column) -> Column:
    """What stands before the first blank line, or else the first 200 characters."""
    return F.when(F.instr(text, "\n\n") > 0, F.substring_index(text, "\n\n", 1)).otherwise(F.left(text, F.lit(200)))


def title_matches(docs: DataFrame, tickers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ticker): the least ticker of three or more letters that is a space-separated word of the title.

    Words meet tickers in a hash join; no title is compared with every ticker.
    """
    words = docs.select(key, F.explode(F.array_distinct(F.split(F.upper(title(F.col(text))), " "))).alias("ticker")).where(F.length("ticker") >= 3)
    return words.join(tickers.select("ticker").distinct(), "ticker").groupBy(key).agg(F.min("ticker").alias("ticker"))


def tag_matches(docs: DataFrame, tickers: DataFrame, key: str, extra: str) -> DataFrame:
    return docs.select(key, F.explode(tags(F.col(extra))).alias("ticker")).join(tickers.select("ticker").distinct(), "ticker")


#: Characters that a piece of a concatenation begins with at most.
PIECE_CHARS = 1 << 20


def quarterly_pieces(docs: DataFrame, most: int = 5000, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(ticker, quarter, piece, n_docs, text): the first most characters of each document and a blank line, in order of (doc_date, doc_id), in pieces.

    A document begins in the piece that its place in the whole, a sum of the characters before it, falls into; so pieces
    joined in order are the whole, and no row holds more than piece_chars and one document. Sums are taken over days
    first, so a task orders one day of one ticker. Null texts are left out of the text, but counted.
    """
    key = ["ticker", "quarter"]
    d = docs.select("ticker", F.trunc("doc_date", "quarter").alias("quarter"), "doc_date", "doc_id", F.concat(F.left("text", F.lit(most)), F.lit("\n\n")).alias("t"))
    d = d.withColumn("_c", F.coalesce(F.length("t"), F.lit(0)).cast("long"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*key).orderBy("doc_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = d.groupBy(*key, "doc_date").agg(F.sum("_c").alias("_c")).select(*[F.col(c).alias(f"_{c}") for c in (*key, "doc_date")], before.alias("_before"))
    same = F.lit(True)
    for c in (*key, "doc_date"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = F.coalesce(F.sum("_c").over(Window.partitionBy(*key, "doc_date").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(days, same).withColumn("piece", F.floor((F.col("_before") + within) / piece_chars))
    g = d.groupBy(*key, "piece").agg(F.array_sort(F.collect_list(F.struct("doc_date", "doc_id", "t"))).alias("xs"), F.count("*").alias("n_docs"))
    return g.select(*key, "piece", "n_docs", F.array_join(F.transform("xs", lambda x: x["t"]), "").alias("text"))


def quarterly_concat(docs: DataFrame, most: int = 5000) -> DataFrame:
    """(ticker, quarter, n_docs, text): quarterly_pieces() joined, for those who need a text in one row."""
    g = quarterly_pieces(docs, most).groupBy("ticker", "quarter").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("xs"), F.sum("n_docs").alias("n_docs"))
    return g.select("ticker", "quarter", "n_docs", F.array_join(F.transform("xs", lambda x: x["text"]), "").alias("text"))


def concat_digests(pieces: DataFrame) -> DataFrame:
    """(ticker, quarter, n_docs, text_md5) of quarterly_pieces(): pieces stream through the hash in order, a whole is never held."""
    rows = pieces.select("ticker", "quarter", "piece", "n_docs", "text")
    kinds = dict(rows.dtypes)
    schema = f"ticker {kinds['ticker']}, quarter {kinds['quarter']}, n_docs long, text_md5 string"

    def run(batches):  # noqa: ANN001, ANN202
        import hashlib
        from itertools import groupby

        import pyarrow as pa

        types = None
        flat = (r for b in batches for r in zip(*(b.column(k) for k in (0, 1, 3, 4))))
        for _, group in groupby(flat, key=lambda r: (r[0].as_py(), r[1].as_py())):
            n, h = 0, hashlib.md5()
            for ticker, quarter, docs, part in group:
                types, first = (ticker.type, quarter.type), (ticker.as_py(), quarter.as_py())
                n += docs.as_py()
                h.update((part.as_py() or "").encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([first[0]], types[0]), pa.array([first[1]], types[1]), pa.array([n], pa.int64()), pa.array([h.hexdigest()])], names=["ticker", "quarter", "n_docs", "text_md5"])

    return rows.repartition("ticker", "quarter").sortWithinPartitions("ticker", "quarter", "piece").mapInArrow(run, schema)


def keep_most_words(docs: DataFrame, by: list[str], count: str, tie: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(count).desc(), tie))
    return docs.withColumn("_rn", rn).where(F.col("_rn") == 1).drop("_rn")


def keep_last(docs: DataFrame, by: list[str], order: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))
    return docs.withColumn("_rn", rn).where(F.col("_rn") == 1).drop("_rn")


def pending(work: DataFrame, done: DataFrame, key: str = "ticker") -> DataFrame:
    """Work that has no result yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def with_filing_dates(index: DataFrame, dates: DataFrame) -> DataFrame:
    """index with filed_date from (ticker, year, filed_date), or else March 15 of the year after."""
    return index.join(dates, ["ticker", "year"], "left").withColumn("filed_date", F.coalesce("filed_date", F.make_date(F.col("year") + 1, F.lit(3), F.lit(15))))


def with_transcript_dates(index: DataFrame, dates: DataFrame) -> DataFrame:
    """index with call_date from (ticker, quarter, year, call_date), or else the 28th of the quarter's last month."""
    fallback = F.make_date(F.col("year"), F.least(F.col("quarter") * 3, F.lit(12)), F.lit(28))
    return index.join(dates, ["ticker", "quarter", "year"], "left").withColumn("call_date", F.coalesce("call_date", fallback))


def transcript_parts(name: Column) -> tuple[Column, Column]:
    """Quarter and year from a file name Qn_YYYY.txt (as a prefix), null if it is none."""
    part = lambda k: F.nullif(F.regexp_extract(name, r"^Q(\d+)_(\d{4})\.txt", k), F.lit("")).cast("int")
    return part(1), part(2)
