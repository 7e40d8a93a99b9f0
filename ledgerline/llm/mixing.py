"""Mixing sources to target weights [native]: a low-discrepancy source schedule over shuffled equal-token blocks.

Each source's documents, ordered by the md5 of their ids, make one stream of words that is cut into blocks of equal
size. Slot i of the schedule goes to the source in whose part of [0, 1) the golden-ratio point frac(i * g) falls; the
k-th slot of a source takes its block k, and starts over when the stream is used up. Ranks and stream positions come
from two levels (within a hash bucket or a chunk of slots, then over at most 1,024 bucket sums), so no source has to
pass through one task. Rows alike in id, source and size are counted before they are placed, and dealt out again after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, cut, documents, small, word_count

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 1024
#: The golden ratio less 1, times 2 to the 62: integers keep the points of any slot exact.
GOLDEN = (1 << 62) * 6180339887498948482 // 10**19
CHUNKS, CELLS, CELL_SLOTS = 256, 1 << 20, 64
#: Rows alike in id, source and size that one row may stand for while they are dealt out.
ALIKE = 1000


def golden_point(slot: Column) -> Column:
    """frac(slot * GOLDEN / 2**62) as a double below 1, from products of 31-bit halves; slots up to 2**62."""
    low, half = (1 << 31) - 1, 31
    s0, s1 = slot.bitwiseAND(F.lit(low)), F.shiftright(slot, half)
    g0, g1 = F.lit(GOLDEN & low), F.lit(GOLDEN >> half)
    upper = F.shiftleft((s1 * g0 + s0 * g1).bitwiseAND(F.lit(low)), half)
    return F.shiftright((upper + s0 * g0).bitwiseAND(F.lit((1 << 62) - 1)), 9) / F.lit(float(1 << 53))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, sid (place by code point, null last), source_size, weight, target; sized has source and size.

    target: share of all sizes dealt by weight; a target stops at most times its source's size, and the excess is
    dealt anew by weight among the rest. In order of size per weight the sources that stop come first, so that one
    running sum finds the water level. One row for each source passes one task.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("sid") % len(weights) + 1).cast("long"))
    cap = (F.lit(most) * F.col("source_size")).alias("cap")
    s = s.select("*", cap, (F.lit(share) * F.sum("source_size").over(Window.partitionBy())).alias("total"))
    by_level = Window.orderBy((F.col("cap") * F.lit(1.0) / F.col("weight")).asc(), F.col("sid").asc())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumns({"below": F.coalesce(F.sum("cap").over(before), F.lit(0)), "left_w": F.sum("weight").over(after)})
    s = s.withColumn("full", F.col("cap") <= F.col("weight") * (F.col("total") - F.col("below")) / F.col("left_w"))
    every = Window.partitionBy()
    s = s.withColumns({"capped": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every), "free_w": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)})
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("total") - F.col("capped")) / F.greatest(F.col("free_w"), F.lit(1)))
    return s.select("source", "sid", "source_size", "weight", target.alias("target"))


def _with_slots(targets: DataFrame, block: int) -> DataFrame:
    """Adds words (the target as a whole number), blocks (of a source's stream) and slots (that its target needs)."""
    words, size = F.floor(F.col("target") + 0.5), F.col("source_size")
    ceil = lambda x: F.ceil(x / F.lit(float(block)))
    slots = F.when(size <= 0, F.lit(0)).when(words <= size, ceil(words)).otherwise(ceil(size) + ceil(words - size))
    return targets.withColumns({"words": words, "blocks": ceil(size), "slots": slots.cast("long")})


def schedule(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """slot, sid, rank: the order in which the mix takes blocks; each source has exactly the slots that its target needs.

    targets (cut before) is as source_targets() gives it. A source's points in the first N of the sequence can differ
    from its share by a few; ranks beyond its need are dropped, and missing ones follow at the end.
    """
    spark = targets.sparkSession
    t = _with_slots(targets, block)
    n = t.agg(F.sum("slots")).first()[0] or 0
    t = t.where("slots > 0")
    if not n:
        return spark.range(0).selectExpr("id AS slot", "CAST(id AS INT) AS sid", "id AS rank")
    cells = int(min(CELLS, max(1, n // CELL_SLOTS)))
    upto = F.sum("slots").over(Window.orderBy("sid"))
    bounds = t.select("sid", "slots", ((upto - F.col("slots")) / F.lit(float(n))).alias("lo"), (upto / F.lit(float(n))).alias("hi"))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    parts = bounds.select("sid", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    slots = spark.range(n).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u")).withColumn("cell", cell(F.col("u")))
    dealt = slots.join(parts, "cell").where("u >= lo AND u < hi").select("slot", "sid", F.floor(F.col("slot") * F.lit(CHUNKS) / F.lit(n)).cast("int").alias("chunk"))
    dealt = dealt.withColumn("within", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    counts = dealt.groupBy("sid", "chunk").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("sid", "chunk", "before")
    need = t.select("sid", "slots")
    ranked = dealt.join(before, ["sid", "chunk"]).join(F.broadcast(need) if small(need, 100_000)[1] else need, "sid")
    ranked = ranked.select("slot", "sid", (F.col("before") + F.col("within")).alias("rank"), "slots").where("rank < slots").select("slot", "sid", "rank")
    had = need.join(counts.groupBy("sid").agg(F.sum("c").alias("had")), "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    late = had.select("sid", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("rank")).select((F.lit(n) + F.col("rank")).alias("slot"), "sid", "rank")
    return ranked.unionByName(late)


def sized_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents): what the mix takes, block by block, and per document.

    pieces: slot (null if no slot takes it), doc_id, copy (a number for each row alike in doc_id, source and size), pass, first and
    taken (words of the document from the first-th on). documents: doc_id, size, source_size, target, taken, source.
    A null text has size 0 and nothing is taken; a null source is a source, the last; a null or repeated doc_id is
    handled as any other row. An empty table gives none. If all sizes are 0, so are all targets.
    """
    sized = cut(sized_rows(docs, key, text, source))
    targets = cut(source_targets(sized, weights, share, most))
    t = _with_slots(targets, block)
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    t, _ = small(t, 100_000)
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    rows = alike.join(t, alike.source.eqNullSafe(t.source)).select("doc_id", alike.source, "size", "n", "sid", "source_size", "target", "words", "blocks", hashed.alias("h"))
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 3), 16, 10).cast("int"), 2))
    order = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size")
    every = F.col("size") * F.col("n")
    rows = rows.withColumn("at", F.sum(every).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - every)
    sums = rows.groupBy("sid", "bucket").agg(F.sum(every).alias("s"))
    start = sums.select("sid", "bucket", F.coalesce(F.sum("s").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    rows = cut(rows.join(start, ["sid", "bucket"]).withColumn("at", F.col("at") + F.col("start")))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(ALIKE).cast("long")))
    crowds = rows.where(F.col("n") > ALIKE)
    rows = rows.where(F.col("n") <= ALIKE).withColumn("from", F.lit(0).cast("long"))
    if not crowds.isEmpty():  # one row can't be made into all its copies in one task
        rows = rows.unionByName(crowds.withColumn("from", first).repartition("doc_id", "from"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("n"), F.col("from") + ALIKE) - 1))).drop("from", "n", "h")
    rows = rows.withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    b = F.lit(block)
    # a document without words takes part in no block; the number below 0 only spreads such rows
    over = F.when(F.col("size") > 0, F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).otherwise(F.array(-1 - F.pmod(F.xxhash64("doc_id", "copy"), F.lit(4096))))
    parts = rows.withColumn("block", F.explode(over))
    slots = schedule(targets, block).join(t.select("sid", "blocks", "source_size", "words"), "sid")
    slots = slots.select("slot", "sid", F.expr("rank div blocks").alias("pass"), F.expr("rank % blocks").alias("block"), "source_size", "words")
    took = F.least(b, F.col("source_size") - F.col("block") * b, F.col("words") - F.col("pass") * F.col("source_size") - F.col("block") * b)
    slots = slots.select("slot", "sid", "pass", "block", took.alias("took"))
    pieces = parts.join(slots, ["sid", "block"], "left")
    lo = F.greatest(F.col("at"), F.col("block") * b)
    hi = F.least(F.col("at") + F.col("size"), F.col("block") * b + F.col("took"))
    pieces = pieces.select("slot", "doc_id", "source", "size", "source_size", "target", "sid", "copy", "pass", (lo - F.col("at")).alias("first"), F.when(F.col("took").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), hi - lo)).alias("taken"))
    whole = pieces.groupBy("sid", "copy", "doc_id", "source", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return pieces, whole.select("doc_id", "size", "source_size", "target", "taken", "source")


def first_words(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, n), " ")


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with copy: 0, 1, 2, ... among those of equal key, from ranks within parts of the input and sums over the parts."""
    rows = cut(rows.withColumn("uid", F.monotonically_increasing_id())).withColumn("chunk", F.shiftright("uid", 33))
    within = Window.partitionBy(*key, "chunk").orderBy("uid")
    sums = rows.groupBy(*key, "chunk").agg(F.count("*").alias("c"))
    before = sums.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*[F.col(k).alias(f"b_{k}") for k in key], F.col("chunk").alias("b_chunk"), "before")
    same = F.col("chunk") == F.col("b_chunk")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    return rows.withColumn("within", F.row_number().over(within) - 1).join(before, same).withColumn("copy", F.col("within") + F.col("before"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs: one for each pass in which words of the document are taken, with docs' columns.

    A document that a target cuts short has its first words (joined by single spaces) as its text, and n_chars to fit.
    Rows alike in doc_id, source and size are numbered, and each gets what the mix takes of that number. Documents of which
    nothing is taken don't come; null sources are a source; an empty table gives none. The columns may have any names.
    """
    name, text, source = options.get("key", "doc_id"), options.get("text", "text"), options.get("source", "source")
    pieces, _ = mix(docs, **options)
    takes = pieces.where("taken > 0").groupBy("copy", "doc_id", "source", "size", "pass").agg(F.sum("taken").alias("taken"))
    takes = takes.groupBy("doc_id", "source", "size", "copy").agg(F.array_sort(F.collect_list(F.struct("pass", "taken"))).alias("passes"))  # at most `most` of them
    takes = cut(takes.select(F.col("doc_id").alias("t_doc"), F.col("source").alias("t_source"), F.col("size").alias("t_size"), F.col("copy").alias("t_copy"), F.col("passes.taken").alias("takes")))
    columns, kinds = docs.columns, dict(docs.dtypes)
    own = {c: f"c_{i}" for i, c in enumerate(columns)}
    key = [own[name], own[source], "size"]
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()]).withColumn("size", word_count(F.col(own[text])))
    again = cut(takes.where("t_copy > 0").select(F.col("t_doc").alias("a_doc"), F.col("t_source").alias("a_source"), F.col("t_size").alias("a_size")).distinct())
    if again.isEmpty():
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
    else:
        again, _ = small(again)
        same = F.col(key[0]).eqNullSafe(F.col("a_doc")) & F.col(key[1]).eqNullSafe(F.col("a_source")) & (F.col("size") == F.col("a_size"))
        alone = rows.join(again, same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
        rows = alone.unionByName(_numbered(rows.join(again, same, "left_semi"), key).select(*alone.columns))
    takes, _ = small(takes)
    rows = rows.join(takes, F.col(key[0]).eqNullSafe(F.col("t_doc")) & F.col(key[1]).eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size")) & (F.col("copy") == F.col("t_copy")))
    rows = rows.withColumn("take", F.explode("takes"))
    short = F.col("take") < F.col("size")
    out = dict(own) | {text: "new_text"}
    rows = rows.withColumn("new_text", F.when(short, first_words(F.col(own[text]), F.col("take").cast("int"))).otherwise(F.col(own[text])))
    if "n_chars" in columns:
        rows = rows.withColumn("new_n", F.when(short, F.length("new_text").cast(kinds["n_chars"])).otherwise(F.col(own["n_chars"])))
        out["n_chars"] = "new_n"
    return rows.select(*[F.col(out[c]).alias(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))[1]


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][sid % 3 + 1] AS BIGINT) AS weight, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap * 1.0::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(weight) OVER (ORDER BY cap * 1.0::DOUBLE / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM w),
f AS (SELECT *, cap <= CAST(weight AS DOUBLE) * (total - CAST(below AS DOUBLE)) / CAST(left_w AS DOUBLE) AS is_full FROM l),
g AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS capped, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS free_w FROM f),
t AS (SELECT source, sid, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
             ELSE CAST(weight AS DOUBLE) * (total - CAST(capped AS DOUBLE)) / CAST(greatest(free_w, 1) AS DOUBLE) END AS target FROM g),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.source, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
             CAST(sum(d.size) OVER (PARTITION BY t.sid ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       greatest(0, least(pos + size, words, source_size) - pos) + greatest(0, least(pos + size, words - source_size) - pos) AS taken, source
FROM p
"""
