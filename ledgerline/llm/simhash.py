"""SimHash near-duplicates: fingerprints of word shingles, linked by BK-trees.

Two fingerprints with at most 3 differing bits agree in at least 2 of 5 bands, so each of the 10 pairs of bands is a
key under which they meet; the fingerprints of a key are a shard with a BK-tree of its own. The trees of all shards
grow with the corpus, so they are not broadcast: the distinct fingerprints of a shard travel (8 bytes each), and the
tree is built where they meet. A shard of more than SHARD fingerprints is split again by parts of its other bits, of
which one must agree too; what is still too large is dealt into blocks, and each two blocks meet in a task of their
own, one as the tree and one as its queries. A task returns a forest of its links, never pairs.

64 bits at 3 differences are strict: near_dedup() links what its radius says. similar_dedup() links texts that share 0.8
of their five-word shingles: there MinHash bands are the shards, trees are searched with a radius that such pairs hardly
exceed, and what they find is compared by whole MinHash fingerprints. Pairs whose estimate is near the limit, and that
no surer links connect, are compared by their sets of shingles in a second pass over their shards alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, documents, held_by, per_text, small
from ledgerline.llm.components import components
from ledgerline.llm.minhash import BITS, Fingerprinter

RADIUS, SHINGLE, SHARD = 3, 3, 2048
#: First bit and width of each band.
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_PIECE = 1 << 15
#: Of similar texts: least likeness, words of a shingle, the trees' radius (pairs of 0.8 differ in 10 bits of 64 on average, by a deviation of 3),
#: bands of bins and bins of each (a pair of 0.8 meets in one of 20 with 0.998).
LIKENESS, WORDS, WIDE, MIN_BANDS, BAND_BINS = 0.8, 5, 20, 20, 6
#: Estimates (deviation 0.02) so far from the limit decide alone. Sets are whole up to HASHES shingles; beyond, the least so many stand for them (deviation 0.006).
MARGIN, HASHES = 0.07, 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles: a bit is 1 if it is set in over half of their XXH64 (seed 42)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and white space count
    if not words:
        return 0
    digest, glue = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        part = words[at : at + _PIECE + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle))) if len(words) >= shingle else [words]
        h = np.array([digest(glue(g), 42) for g in grams], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row; a null text is empty, an empty one has 0."""

    def run(texts: list[str | None]) -> list[tuple]:
        return [(x,) for x in np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64).tolist()]

    return per_text(docs, key, text, run, "fp long")


def _shards(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links of each shard; rows come sorted by (key, i, j, side), a shard's rows may span batches."""
    from ledgerline.llm.bktree import forest

    def links(rows: np.ndarray) -> Iterator[pd.DataFrame]:
        """rows: whole shards; columns key, i, j, side, fp."""
        if not len(rows):
            return
        new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(rows)]
        found = []
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            fp, i, j = rows[s:e, 4].view(np.uint64), rows[s, 1], rows[s, 2]
            if i == j:
                found.append(forest(fp, None, radius))
            else:
                tree = rows[s:e, 3] == i
                if tree.any() and not tree.all():
                    found.append(forest(fp[tree], fp[~tree], radius))
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pd.DataFrame({"a": a, "b": b})

    rest = np.zeros((0, 5), np.int64)
    for batch in batches:
        rows = np.concatenate([rest, batch[["key", "i", "j", "side", "fp"]].to_numpy(np.int64)])
        last = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])[-1] if len(rows) else 0
        yield from links(np.ascontiguousarray(rows[:last]))
        rest = rows[last:]
    yield from links(np.ascontiguousarray(rest))


def link(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, bands: tuple = BANDS) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all links of at most radius bits; fps (fp) is distinct."""
    agree = len(bands) - radius
    assert agree >= 1, "a radius needs more bands"
    rest = [[b for c, (at, width) in enumerate(bands) if c not in chosen for b in range(at, at + width)] for chosen in combinations(range(len(bands)), agree)]
    masks = [[sum(1 << b for b in bits[j :: radius + 1]) for j in range(radius + 1)] for bits in rest]
    masks = F.array(*[F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in of]) for of in masks])
    value = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in bands]
    keys = []
    for k, chosen in enumerate(combinations(range(len(bands)), agree)):
        key = F.lit(k).cast("long")
        for c in chosen:
            key = F.shiftleft(key, bands[c][1]).bitwiseOR(value[c])
        keys.append(key)
    keyed = fps.select("fp", F.posexplode(F.array(*keys)).alias("k", "key"))
    crowded = cut(keyed.groupBy("key").count().where(F.col("count") > shard).select("key", F.lit(True).alias("crowded")))
    if crowded.isEmpty():
        hot = crowded.select("key", F.lit(1).alias("blocks"))
    else:  # the bits outside the chosen bands differ in at most radius places, so one of radius + 1 parts of them agrees
        crowded, _ = small(crowded)
        parts = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda j: F.xxhash64("key", j, F.col("fp").bitwiseAND(F.get(F.get(masks, F.col("k")), j))))
        keyed = cut(keyed.join(crowded, "key", "left").select("fp", "crowded", F.explode(F.when(F.col("crowded"), parts).otherwise(F.array("key"))).alias("key")))
        hot = cut(keyed.where("crowded").groupBy("key").count().where(F.col("count") > shard).select("key", F.ceil(F.col("count") / shard).cast("int").alias("blocks")))
    hot, _ = small(hot)
    dealt = keyed.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("side", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("side", j).alias("i"), F.greatest("side", j).alias("j")))
    cells = dealt.select("key", "fp", "side", F.explode(meets).alias("cell")).select("key", "cell.i", "cell.j", "side", "fp")
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return cells.mapInPandas(lambda batches: _shards(batches, radius), "a long, b long")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that links lead to, for every row.

    Rows link if their fingerprints differ in at most radius bits; rows of equal fingerprints (among them copies and
    repeated rows) are one class from the start. Null and empty texts have fingerprint 0, which links as any other.
    A null key is no component's least unless its component has no other. An empty table gives none.
    """
    rows = cut(fingerprints(docs, key, text, shingle))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(components(link(classes.select("fp"), radius)))
    linked = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "component_id")
    # cut, so that the last join has exchanges of its own on both sides and a hot fingerprint can be split
    ids = cut(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    out = rows.join(ids, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay, all columns: of each component of near_dedup() one that has its least key.

    Rows that repeat a key are told apart by their fingerprints. Null texts are empty ones, an empty table gives none,
    and the columns may have any names.
    """
    found = near_dedup(docs, key, text, shingle, radius).select(F.col("doc_id").alias("id"), F.conv("fingerprint", 16, -10).cast("long").alias("mark"), "component_id")
    return _staying(docs, key, text, cut(found), lambda rows, row, content: fingerprints(rows, row, content, shingle).withColumnRenamed("fp", "mark"))


def _staying(docs: DataFrame, key: str, text: str, found: DataFrame, marked: Callable) -> DataFrame:
    """docs without the rows that found (id, mark, component_id; cut before) does not keep; marked() gives rows (doc_id, mark) of repeated keys again."""
    again = cut(found.groupBy("id").count().where("count > 1").select(F.col("id").alias("again")))
    gone, _ = small(cut(found.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("gone")).distinct()))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(docs.columns)])
    mine, content = (f"c_{docs.columns.index(c)}" for c in (key, text))
    left = rows.join(gone, F.col(mine).eqNullSafe(F.col("gone")), "left_anti")
    if not again.isEmpty():
        again, _ = small(again)
        twice = F.col(mine).eqNullSafe(F.col("again"))
        known = marked(rows.join(again, twice, "left_semi").withColumn("row", F.struct(*rows.columns)), "row", content)
        stay = found.where(F.col("id").eqNullSafe(F.col("component_id"))).join(again, F.col("id").eqNullSafe(F.col("again")), "left_semi").distinct()
        stay = stay.select("id", F.col("mark").alias("found_mark"), "component_id")
        once = known.join(stay, F.col(f"doc_id.{mine}").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("found_mark"))).dropDuplicates(["component_id"]).select("doc_id.*")
        left = left.join(again, twice, "left_anti").unionByName(once)
    return left.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)])


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, with_sets: bool = False) -> DataFrame:
    """doc_id, fp (SimHash of the set of shingles), print (packed MinHash), bands (hashes of bins) for every row; a null text is empty.

    with_sets adds the set itself: its hashes in order, at most HASHES of them.
    """

    def run(texts: list[str | None]) -> list[tuple]:
        of, out = held_by(("sketches", words), lambda: Fingerprinter(shingle=words)), []
        for t in texts:
            h = np.unique(of.shingles(of.words(t)))
            counts = sum((np.unpackbits(h[at : at + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for at in range(0, len(h), _PIECE)), np.zeros(64, np.int64))
            fp = np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0]
            value = of.least(h)
            band = np.full(MIN_BANDS, 0x9E3779B97F4A7C15, np.uint64)
            for part in value[: MIN_BANDS * BAND_BINS].reshape(MIN_BANDS, BAND_BINS).T:
                band = (band ^ part) * np.uint64(0x100000001B3)
                band ^= band >> np.uint64(29)
            band += np.arange(MIN_BANDS, dtype=np.uint64)  # equal values in two bands are two keys
            row = (int(fp), of.pack(value).tobytes(), band.view(np.int64).tolist())
            out.append((*row, h[:HASHES].astype("<u8").tobytes()) if with_sets else row)
        return out

    return per_text(docs, key, text, run, "fp long, print binary, bands array<long>" + ", hashes binary" * with_sets)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of each two rows of tables of packed MinHash fingerprints, without the agreement that chance gives."""
    x = a ^ b
    per = 8 // BITS
    differ = sum(((x >> np.uint8(BITS * k)) & np.uint8((1 << BITS) - 1) != 0).sum(axis=1) for k in range(per))
    chance = 2.0**-BITS
    return (1 - differ / (x.shape[1] * per) - chance) / (1 - chance)


def likeness_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of ordered hashes; of a cut set only what lies up to its last hash is known, and compared."""
    reach = min([int(x[-1]) for x in (a, b) if len(x) == HASHES], default=None)
    if reach is not None:
        a, b = (x[: np.searchsorted(x, np.uint64(reach), side="right")] for x in (a, b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


_CELL = ["key", "i", "j"]


def _by_shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each shard of two or more; rows come sorted by (key, i, j), a shard's may span batches."""
    rest: list[pd.DataFrame] = []  # of the last shard so far
    for batch in batches:
        if not len(batch):
            continue
        place = batch[_CELL].to_numpy()
        starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)])
        for s, e in zip(starts, np.r_[starts[1:], len(batch)]):
            if rest and (rest[0][_CELL].iloc[0].to_numpy() != place[s]).any():
                if sum(map(len, rest)) > 1:
                    yield rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)
                rest = []
            rest.append(batch.iloc[s:e])
    if sum(map(len, rest)) > 1:
        yield pd.concat(rest, ignore_index=True)


def _gathered(parts: Iterator[np.ndarray], columns: list[str], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """Tables of longs put together into frames of at least so many rows."""
    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= rows or len(held) >= rows:
            yield pd.DataFrame(np.concatenate(held), columns=columns)
            held = []
    if held:
        yield pd.DataFrame(np.concatenate(held), columns=columns)


def _candidates(rows: pd.DataFrame, parent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (places of rows) of a shard that its tree finds and parent does not connect by then, with estimated likeness, some at a time."""
    from ledgerline.llm.bktree import BKTree, QUERIES, _root

    fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
    prints = np.frombuffer(b"".join(rows["print"]), np.uint8).reshape(len(rows), -1)
    i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    side = rows["side"].to_numpy() == i
    tree, asked = (np.arange(len(rows)), np.arange(len(rows))) if i == j else (np.flatnonzero(side), np.flatnonzero(~side))
    if not len(tree) or not len(asked):
        return
    values, of = np.unique(fp[tree], return_inverse=True)
    order = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[order], np.arange(len(values) + 1))
    grown = BKTree(values)
    for at in range(0, len(asked), QUERIES):
        q, v = grown.search(fp[asked[at : at + QUERIES]], WIDE)
        n = begin[v + 1] - begin[v]
        a = asked[at + np.repeat(q, n)]
        b = tree[order[np.repeat(begin[v] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(a))]] if len(a) else a
        for k in range(0, len(a), 2048):  # what is connected by now needs no comparison
            x, y = a[k : k + 2048], b[k : k + 2048]
            apart = _root(parent, x) != _root(parent, y)
            if i == j:
                apart &= x < y
            if apart.any():
                yield x[apart], y[apart], estimated(prints[x[apart]], prints[y[apart]])


def _similar_shards(batches: Iterator[pd.DataFrame], likeness: float) -> Iterator[np.ndarray]:
    """Of each shard (rows key, i, j, side, node, fp, print) a forest of its sure links as rows (a, b, 0, ...), and (a, a, 1, key, i, j, side) for classes of doubtful pairs."""
    from ledgerline.llm.bktree import _root, join

    for rows in _by_shard(batches):
        parent, doubtful = np.arange(len(rows)), np.zeros(len(rows), bool)
        for x, y, near in _candidates(rows, parent):
            sure = near >= likeness + MARGIN
            join(parent, x[sure], y[sure])
            doubt = ~sure & (near >= likeness - MARGIN)
            doubtful[x[doubt]] = doubtful[y[doubt]] = True
        root, node = _root(parent, np.arange(len(rows))), rows["node"].to_numpy(np.int64)
        moved = np.flatnonzero(root != np.arange(len(rows)))
        if len(moved):
            links = np.zeros((len(moved), 7), np.int64)
            links[:, 0], links[:, 1] = node[moved], node[root[moved]]
            yield links
        if doubtful.any():
            open_ = node[doubtful]
            yield np.column_stack([open_, open_, np.ones(len(open_), np.int64), rows[[*_CELL, "side"]].to_numpy(np.int64)[doubtful]])


def _doubtful_shards(batches: Iterator[pd.DataFrame], likeness: float) -> Iterator[np.ndarray]:
    """Links (a, b) of the doubtful pairs of each shard whose sets are alike; rows have root, what the class is linked to by then, and hashes besides."""
    from ledgerline.llm.bktree import _root, join

    for rows in _by_shard(batches):
        _, first, root = np.unique(rows["root"].to_numpy(np.int64), return_index=True, return_inverse=True)
        parent = first[root]
        node, sets, found = rows["node"].to_numpy(np.int64), [np.frombuffer(h, "<u8") for h in rows["hashes"]], []
        for x, y, near in _candidates(rows, parent):
            for k in np.argsort(-near, kind="stable"):  # the likeliest first: what they connect needs no comparison
                if near[k] < likeness - MARGIN:
                    break
                a, b = x[k : k + 1], y[k : k + 1]
                if _root(parent, a)[0] != _root(parent, b)[0] and likeness_of(sets[a[0]], sets[b[0]]) >= likeness:
                    join(parent, a, b)
                    found.append((node[a[0]], node[b[0]]))
        if found:
            yield np.array(found, np.int64)


def _doubtful_links(docs: DataFrame, key: str, text: str, words: int, likeness: float, classes: DataFrame, doubts: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (a, b) among the classes of doubts (node and its shard) that roots does not connect yet; only their texts are read again."""
    doubts = cut(doubts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    open_cells = doubts.groupBy(*_CELL).agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select(*_CELL)
    doubts = cut(doubts.join(open_cells, _CELL, "left_semi"))
    nodes = cut(classes.select("node", "fp", "print", "least").join(doubts.select("node").distinct(), "node", "left_semi"))
    ids, _ = small(cut(nodes.select("least").distinct()))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("content"))
    again = sketches(rows.join(ids, F.col("id").eqNullSafe(F.col("least")), "left_semi"), "id", "content", words, with_sets=True)
    sets = nodes.join(again.select("fp", "print", "hashes").dropDuplicates(["fp", "print"]), ["fp", "print"]).select("node", "fp", "print", "hashes")
    cells = doubts.join(cut(sets), "node").select(*_CELL, "side", "node", "root", "fp", "print", "hashes")
    cells = cells.repartition(*_CELL).sortWithinPartitions(*_CELL, "side")
    return cut(cells.mapInPandas(lambda batches: _gathered(_doubtful_shards(batches, likeness), ["a", "b"]), "a long, b long"))


def similar_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", likeness: float = LIKENESS, words: int = WORDS, shard: int = SHARD) -> DataFrame:
    """doc_id, mark (of its sketch), component_id: the least doc_id that links lead to, for every row.

    Rows link if likeness or more of their shingles' union is shared; the MinHash estimate decides where it is MARGIN or
    more from that, their sets elsewhere. Rows of equal sketches are one class from the start. Only keys that several
    classes share travel with fingerprints, only doubtful classes with sets. A band of more than shard classes is dealt
    into blocks that meet two by two. Null texts are empty, which are alike; a null key is no component's least unless
    its component has no other. An empty table gives none.
    """
    mark = F.xxhash64("fp", "print")
    rows = cut(sketches(docs, key, text, words).withColumn("mark", mark))
    classes = rows.groupBy("fp", "print", "mark").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    keyed = classes.select("node", F.explode("bands").alias("key"))
    shared = cut(keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / shard).cast("int").alias("blocks")))
    shared, _ = small(shared)
    dealt = keyed.join(shared, "key").withColumn("side", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("side", j).alias("i"), F.greatest("side", j).alias("j")))
    cells = dealt.select("key", "node", "side", F.explode(meets).alias("cell")).select("key", "cell.i", "cell.j", "side", "node")
    cells = cells.join(classes.select("node", "fp", "print"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    columns = ["a", "b", "doubtful", *_CELL, "side"]
    found = cut(cells.mapInPandas(lambda batches: _gathered(_similar_shards(batches, likeness), columns), ", ".join(f"{c} long" for c in columns)))
    roots, doubts = cut(components(found.where("doubtful = 0").select("a", "b"))), found.where("doubtful = 1").select(F.col("a").alias("node"), *_CELL, "side")
    if not doubts.isEmpty():
        more = _doubtful_links(docs, key, text, words, likeness, classes, doubts, roots)
        if not more.isEmpty():
            roots = cut(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))
    linked = classes.join(roots, "node").select("node", "root", "least")
    ids = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    ids = cut(classes.join(ids, "node", "left").select("fp", "print", F.coalesce("component_id", "least").alias("component_id")))
    return rows.join(ids, ["fp", "print"]).select("doc_id", "mark", "component_id")


def dedup_similar_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", likeness: float = LIKENESS, words: int = WORDS) -> DataFrame:
    """The rows of docs that stay, all columns: of each component of similar_dedup() one that has its least key.

    Rows that repeat a key are told apart by their sketches. Null texts are empty ones, an empty table gives none, and
    the columns may have any names.
    """
    found = cut(similar_dedup(docs, key, text, likeness, words).select(F.col("doc_id").alias("id"), "mark", "component_id"))
    return _staying(docs, key, text, found, lambda rows, row, content: sketches(rows, row, content, words).withColumn("mark", F.xxhash64("fp", "print")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))
