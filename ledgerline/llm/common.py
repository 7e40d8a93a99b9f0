"""What the operators of this subpackage share: shipping, lineage cuts, size-checked broadcasts, word rules."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StructType, TimestampNTZType, TimestampType

from ledgerline import session
from ledgerline.session import cut, shared_dir  # noqa: F401

#: A word is a run of anything but ASCII white space (bytes.split() has the same rule).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes up to which a table may be broadcast; both are measured before.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
BATCH_ROWS = 1000
FOLDS = 5
#: Words that each of the two generations of a Python worker's table may hold.
KEPT_WORDS = 60_000
_HELD: dict = {}


class Words(dict):
    """A bounded table: when it is full it becomes the old generation, and the one before goes; words used again return."""

    def __init__(self, bound: int = KEPT_WORDS) -> None:
        self.old: dict = {}
        self.bound = bound

    def turn(self) -> None:
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()

    def recall(self, word: str):
        """The old generation's value of a word, which is young again; None if it has none."""
        value = self.old.pop(word, None)
        if value is not None:
            self[word] = value
        return value

    def keep(self, word: str, value) -> None:
        self.turn()
        self[word] = value


def slices(texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """texts in order, in lists of about so many characters, so that what is made of a list at once stays bounded."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def held_by(owner: Hashable, make: Callable):
    """What a worker keeps for one operator, made anew if it kept another's: workers outlive their stages."""
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = make()
    return _HELD[owner]


def released(batches: Iterator) -> Iterator:
    """batches; at their end Arrow gives its free memory back, which an idle worker would keep."""
    import pyarrow as pa

    yield from batches
    pa.default_memory_pool().release_unused()


def ship(spark: SparkSession) -> None:
    """The package to the executors, and batches of a bounded number of rows: whole texts travel in them."""
    session.ship(spark)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def remove(spark: SparkSession, path: str) -> None:
    """A folder of ours goes, in whatever store Spark writes to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row of df, about: eight a column, and what its strings, arrays and the like hold (as text)."""
    fixed = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)
    held = [F.coalesce(F.octet_length(F.col(f"`{f.name}`") if isinstance(f.dataType, BinaryType) else F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema.fields if not isinstance(f.dataType, fixed)]
    return reduce(lambda a, b: a + b, held, F.lit(8 * len(df.columns)))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """df (cut before), with a broadcast hint if its rows and their bytes are within the bounds; and whether they are."""
    n, held = df.agg(F.count("*"), F.sum(row_bytes(df).cast("long"))).first()
    fits = n <= rows and (held or 0) <= size
    return (F.broadcast(df) if fits else df), fits


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(key: str) -> Column:
    """The fold of keys that nothing is learnt from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % FOLDS == 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, label: str, fields: dict[str, str], most: int, salt: str, settle: Callable) -> DataFrame:
    """Rows (y, weight, calibrates, then fields) of at most `most` labelled documents of each label that are not held out.

    Of each label the first by a hash of the key are taken, sorted by that hash; weight is how many each stands for, calibrates a number of [0, 1)
    that the key decides. settle makes one label of a key's several; of a key's several documents the least counts.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("k").isNotNull() & ~held_out("k")).groupBy("k").agg(settle("y").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}  # one row a label
    rows = docs.select(F.col(key).alias("k"), F.struct(*[F.col(c).alias(n) for n, c in fields.items()]).alias("d"))
    number = lambda *x: F.pmod(F.xxhash64(*x), F.lit(1_000_000)) / 1e6
    place, parts = F.col("k").cast("string"), []
    for y, n in sorted(counts.items()):
        # a little more than needed by the hash, then exactly that many: no count of rows is only expected
        near = known.where((F.col("y") == y) & (number(place, F.lit(salt)) < min(1.0, 1.2 * most / n + 50 / n)))
        parts.append(near.withColumn("at", F.xxhash64(place, F.lit(salt))).orderBy("at", "k").limit(most).withColumn("weight", F.lit(max(1.0, n / most))))
    if not parts:
        return rows.limit(0).select(F.lit(0).alias("y"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("calibrates"), "d.*")
    chosen = cut(reduce(DataFrame.unionByName, parts))
    found = rows.join(F.broadcast(chosen), "k").groupBy("k", "y", "at", "weight").agg(F.min("d").alias("d"))
    found = found.repartition(1).sortWithinPartitions("at", "k")
    return found.select("y", "weight", number(F.lit("calibration"), place).alias("calibrates"), "d.*")


def thinned(text: str, chars: int, run: int = 100) -> str:
    """About chars of a longer text: runs of its words at even distances."""
    words = text.split()
    runs = [" ".join(words[k : k + run]) for k in range(0, len(words), run)]
    keep = max(1, int(len(runs) * chars / len(text)))
    return "\n".join(runs[len(runs) * k // keep] for k in range(keep))[:chars] if runs else ""


def affordable(rows: Iterator[tuple], text: int, group: Callable[[tuple], Hashable], chars: int, row_chars: int) -> Iterator[tuple]:
    """The rows whose text is no longer than row_chars and than what the rows before it left of its group's chars; others cost nothing.

    A group of which no row fits gives its shortest one, thinned, so that no class is ever without a row.
    """
    left: dict[Hashable, int] = {}
    spare: dict[Hashable, tuple | None] = {}
    for r in rows:
        g, n = group(r), len(r[text] or "")
        if n <= min(row_chars, left.setdefault(g, chars)):
            left[g] -= n
            spare[g] = None
            yield r
        elif (held := spare.get(g, r)) is not None:
            spare[g] = min(held, r, key=lambda x: len(x[text]))
    for r in spare.values():
        if r is not None:
            yield *r[:text], thinned(r[text], min(chars, row_chars)), *r[text + 1 :]


def learnt(rows: DataFrame, learn: Callable[[Iterator[tuple]], dict], schema: str):
    """The one row that learn() makes of all rows, in one task; rows come as tuples and are bounded by the caller. None if there are none."""
    kinds = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tuples = (r for b in batches for at in range(0, b.num_rows, 100) for r in zip(*(c.to_pylist() for c in b.slice(at, 100).columns)))
        yield pa.RecordBatch.from_pylist([learn(tuples)], schema=kinds)

    return rows.mapInArrow(lambda batches: released(run(batches)), schema).first()


def arrow_schema(schema: str):
    """The Arrow schema of a schema string; only the driver can parse one."""
    return to_arrow_schema(StructType.fromDDL(schema))


def per_text(docs: DataFrame, key: str, text: str, run: Callable[[list[str | None]], list[tuple]], columns: str) -> DataFrame:
    """doc_id and columns (a schema) for every row: run() gets the texts of a batch and returns a tuple for each."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, {columns}"

    kinds = arrow_schema(schema)

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa

        for b in it:
            if not b.num_rows:
                continue
            out = list(zip(*run(b.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(kinds.field(0).type), *(pa.array(list(c), kinds.field(k + 1).type) for k, c in enumerate(out))], schema=kinds)

    return rows.mapInArrow(lambda it: released(batches(it)), schema)
