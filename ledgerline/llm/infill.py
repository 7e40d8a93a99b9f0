"""Fill-in-the-middle: a text is cut at two boundaries of tokens, and its middle goes behind the rest.

A text becomes an array of 32-bit code points. A token is a run of other characters with the white space before it, so
tokens end where a code point that is no white space meets one that is; comparing neighbouring classes finds all of
these at once, the ranks that the key's hash chose are looked up among them, and the slices between are encoded again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_schema, documents, released, slices


@dataclass(frozen=True)
class Infill:
    """Settings: per cent of texts that are cut, per cent of those with the suffix first, seed, and the markers of prefix, suffix and middle."""

    rate: int = 50
    suffix_first: int = 80
    seed: int = 42
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def __post_init__(self) -> None:
        # so marked, no marker can arise from text beside another, and the first one found is the one that was set
        if len(set(self.markers)) < 3 or any(len(m) < 3 or m[0] != "<" or m[-1] != ">" or set("<>") & set(m[1:-1]) for m in self.markers):
            raise ValueError("markers must be three different names between < and >")
        if not (0 <= self.rate <= 100 and 0 <= self.suffix_first <= 100):
            raise ValueError("rates are from 0 to 100")


def token_ends(points: np.ndarray) -> np.ndarray:
    """Where the tokens of an array of code points end; white space at a text's end is a token of its own."""
    if not len(points):
        return np.zeros(0, np.int64)
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    return np.r_[np.flatnonzero(~space[:-1] & space[1:]) + 1, len(points)]


def draws(key: object, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that the key decides; a null key counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def transformed(key: object, text: str | None, how: Infill) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = token_ends(points)
    n = len(ends)
    h1, h2, h3, h4 = draws(key, how.seed)
    if not text or any(m in text for m in how.markers) or h3 % 100 >= how.rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
    prefix, middle, suffix = (s.tobytes().decode("utf-32-le", "surrogatepass") for s in (points[:a], points[a:b], points[b:]))
    p, s, m = how.markers
    if h4 % 100 < how.suffix_first:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", how: Infill = Infill()) -> DataFrame:  # noqa: B008
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output for every row.

    A null or empty text stays empty and plain, as does one that holds a marker. Rows are independent: the key and the
    settings alone decide the cut, so rows that repeat both key and text come out alike, and rows of a null key share
    their draws. An empty table gives none. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(key).cast("string").alias("k"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string"
    kinds = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at = 0
            for part in slices(b.column(1).to_pylist()):
                out = list(zip(*(transformed(k, t, how) for k, t in zip(b.column(2).slice(at, len(part)).to_pylist(), part))))
                ids = b.column(0).slice(at, len(part)).cast(kinds.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), kinds.field(k + 1).type) for k, c in enumerate(out))], schema=kinds)
                at += len(part)

    return rows.mapInArrow(lambda batches: released(run(batches)), schema)


def restored(form: Column, output: Column, how: Infill = Infill()) -> Column:  # noqa: B008
    """The text that an output was made of."""
    p, s, m = how.markers
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
                  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
     v AS (SELECT *, CAST(len(tokens) AS BIGINT) AS n FROM u),
     w AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM v),
     x AS (SELECT *, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:], '') AS s FROM w)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM x
"""
