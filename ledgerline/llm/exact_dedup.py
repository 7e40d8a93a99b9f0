"""Exact deduplication by progressive refinement [native]: length, then prefix hash, then hash of the whole text.

Each level reads only narrow rows of what the level before left: texts of a length of their own are settled by the
length alone, texts whose (length, prefix hash) is unique by the prefix; only the rest have their whole text hashed.
What a level left goes to the next as a bitmap of hashed keys, sized by their number up to a fixed bound, so the plan
is the same for any corpus: a key that meets another's bit only costs a hash, as the next level is exact again.
exact_dedup() passes no text through a shuffle; dedup_rows() passes whole rows only where they are copies and the
groups are too many to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, documents, lower_ascii, small

PREFIX_CHARS = 128
#: Bits that a level's bitmap has for each key that is left, and at most (32 MB); bits of one of its rows.
BITS_A_KEY, MOST_BITS, MAP_BITS = 16, 1 << 28, 1 << 15


def _normal(text: str) -> Column:
    return lower_ascii(F.coalesce(F.col(text), F.lit("")))


def _bitmap(keys: DataFrame, most_bits: int) -> tuple[DataFrame, int]:
    """Rows (map, bits) of the bitmap of keys (_number; cut before), to be broadcast: its size has a bound; and its number of bits."""
    n = keys.count()
    size = min(most_bits, max(MAP_BITS, 1 << (BITS_A_KEY * n).bit_length()))
    at = F.pmod("_number", F.lit(size))
    maps = keys.groupBy(F.floor(at / MAP_BITS).alias("_map")).agg(F.bitmap_construct_agg(at % MAP_BITS).alias("_bits"))
    return F.broadcast(maps), size


def _left(rows: DataFrame, number: Column, bitmap: tuple[DataFrame, int]) -> DataFrame:
    """rows with _hit: whether the bit of number is set."""
    maps, size = bitmap
    rows = rows.withColumn("_at", F.pmod(number, F.lit(size))).withColumn("_map", F.floor(F.col("_at") / MAP_BITS)).join(maps, "_map", "left")
    within = (F.col("_at") % MAP_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(within, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("_hit", F.coalesce((F.floor(byte / F.pow(F.lit(2), within % 8)) % 2) == 1, F.lit(False))).drop("_at", "_map", "_bits")


def _refine(docs: DataFrame, key: str, text: str, prefix_chars: int, carry: dict[str, Column], whole_rows: bool, most_bits: int = MOST_BITS) -> DataFrame:
    """Every row with _doc, _keep, _n (size of its group), _rows (rows that have both its group and the kept key) and _full (null: settled before the last level)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    level = [F.length(raw).alias("_len"), F.xxhash64(lower_ascii(F.left(raw, F.lit(prefix_chars)))).alias("_pre")]
    by_length, by_prefix = F.col("_len").cast("long"), F.xxhash64("_len", "_pre")
    feats = docs.select(*level)
    lengths = cut(feats.groupBy("_len").count().where("count > 1").select(by_length.alias("_number")))
    lengths = _bitmap(lengths, most_bits)
    feats = _left(feats, by_length, lengths).where("_hit")
    pairs = cut(feats.groupBy("_len", "_pre").count().where("count > 1").select(by_prefix.alias("_number")))
    pairs = _bitmap(pairs, most_bits)
    columns = docs.columns if whole_rows else []
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(columns)], *[e.alias(f"x_{n}") for n, e in carry.items()], F.col(key).alias("_doc"), *level, _normal(text).alias("_text"))
    rows = _left(_left(rows, by_length, lengths).withColumnRenamed("_hit", "_long"), by_prefix, pairs)
    rows = rows.withColumn("_full", F.when(F.col("_long") & F.col("_hit"), F.unhex(F.sha2("_text", 256)))).drop("_text", "_len", "_pre", "_long", "_hit")
    by_doc = rows.where("_full IS NOT NULL").groupBy("_full", "_doc").agg(F.count("*").alias("_c"))
    groups = by_doc.groupBy("_full").agg(F.max(F.struct("_doc", "_c")).alias("_top"), F.sum("_c").alias("_n")).where("_n > 1")
    groups = cut(groups.select(F.col("_full").alias("_key"), F.col("_top._doc").alias("_keep"), F.col("_n"), F.col("_top._c").alias("_rows")))
    groups, fits = small(groups)
    if fits:
        found = rows.join(groups, F.col("_full") == F.col("_key"), "left").drop("_key")
    else:  # rows that are settled already stay where they are
        alone = {"_keep": F.lit(None).cast(dict(groups.dtypes)["_keep"]), "_n": F.lit(None).cast("long"), "_rows": F.lit(None).cast("long")}
        found = rows.where("_full IS NOT NULL").join(groups, F.col("_full") == F.col("_key"), "left").drop("_key")
        found = found.unionByName(rows.where("_full IS NULL").withColumns(alone))
    return found.withColumns({"_keep": F.when(F.col("_n").isNull(), F.col("_doc")).otherwise(F.col("_keep")), "_n": F.coalesce("_n", F.lit(1)), "_rows": F.coalesce("_rows", F.lit(1))})


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, then the expressions of carry, computed in the same scan.

    Texts are equal when identical after lower-casing A-Z; null is the empty text. The largest key of a group stays.
    Rows that repeat both key and text are one document: all have the same decision (dedup_rows() keeps one of them).
    A null key is smaller than any other; a group of null keys only keeps null. An empty table gives none.
    Other columns are ignored, whatever their names.
    """
    carry = carry or {}
    out = _refine(docs, key, text, prefix_chars, carry, whole_rows=False)
    return out.select(F.col("_doc").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_n").cast("long").alias("group_size"), F.col("_doc").eqNullSafe(F.col("_keep")).alias("kept"), *[F.col(f"x_{n}").alias(n) for n in carry])


def dedup_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of docs that stay, all columns: exactly one of each group of equal texts.

    Null texts are empty ones; an empty table gives none. The columns may have any names.
    """
    out = _refine(docs, key, text, prefix_chars, {}, whole_rows=True).where(F.col("_doc").eqNullSafe(F.col("_keep")))
    back = [F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)]
    single = out.where("_rows = 1").select(*back)
    repeated = out.where("_rows > 1").dropDuplicates(["_full", "_doc"]).select(*back)
    return single.unionByName(repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), carry={"text_sha256": F.sha2(_normal("text"), 256)})


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
     h AS (SELECT doc_id, sha256(x) AS text_sha256 FROM t)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""
