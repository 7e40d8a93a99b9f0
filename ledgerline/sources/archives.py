"""Factor files as they are published: a percent table of days inside a text, itself often inside a zip archive."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ledgerline.session import ship

#: A line of the daily table: eight digits, a comma.
_DAY = r"^\s*\d{8}\s*,"


class MemberLines:
    """The lines (member, line_no, line) of the CSV and text members of an archive, or of the content itself if it is none."""

    def eval(self, content: bytes) -> Iterator[tuple[str, int, str]]:
        import io
        import zipfile

        if not content:
            return
        if not zipfile.is_zipfile(io.BytesIO(content)):
            for n, line in enumerate(io.TextIOWrapper(io.BytesIO(content), "utf-8", "replace")):
                yield "", n, line.rstrip("\r\n")
            return
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(z.namelist()):
                if name.lower().endswith((".csv", ".txt")):
                    with z.open(name) as f:
                        for n, line in enumerate(io.TextIOWrapper(f, "utf-8", "replace")):
                            yield name, n, line.rstrip("\r\n")


member_lines = udtf(MemberLines, returnType="member string, line_no int, line string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, line_no, line) of all files at path, archives member by member; each line knows its own place."""
    ship(spark)
    spark.udtf.register("member_lines", member_lines)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return spark.sql("SELECT f.path, m.member, m.line_no, m.line FROM {files} f, LATERAL member_lines(f.content) m", files=files)


def daily_tables(lines: DataFrame) -> DataFrame:
    """(path, member, date, name, value) of the daily table in each member: from the first line of a day to the line before the first that begins with no digit.

    Names are those of the last line with a comma before the table. Values are fractions, null where no number stands.
    """
    key = ["path", "member"]
    day = F.col("line").rlike(_DAY)
    begun = lines.groupBy(*key).agg(F.min(F.when(day, F.col("line_no"))).alias("a")).where("a IS NOT NULL")
    inside = lines.join(begun, key)
    end = inside.groupBy(*key, "a").agg(F.min(F.when((F.col("line_no") > F.col("a")) & ~F.col("line").rlike(r"^\s*\d"), F.col("line_no"))).alias("b"), F.max(F.when((F.col("line_no") < F.col("a")) & F.col("line").contains(","), F.struct("line_no", "line"))).alias("h"))
    names = F.transform(F.split("h.line", ","), lambda c: F.trim(c))
    bounds = end.select(*key, "a", F.coalesce("b", F.lit(2**31 - 1)).alias("b"), names.alias("names"))
    rows = lines.join(bounds, key).where((F.col("line_no") >= F.col("a")) & (F.col("line_no") < F.col("b")) & day)
    cells = F.split("line", ",")
    long = rows.select(*key, F.to_date(F.trim(cells[0]), "yyyyMMdd").alias("date"), "names", F.posexplode(F.slice(cells, F.lit(2), F.size(cells))).alias("at", "cell"))
    return long.select(*key, "date", F.get("names", F.col("at") + 1).alias("name"), (F.trim("cell").try_cast("double") / 100).alias("value")).where("name IS NOT NULL AND name <> ''")


def read_factors(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(date, names) of the daily table in a factor file, zipped or plain. Without names, all columns of its header; ValueError if there is no such table."""
    long = daily_tables(read_lines(spark, path))
    found = [r.name for r in long.select("name").distinct().orderBy("name").collect()]  # a header's names
    if not found:
        raise ValueError(f"no daily table in {path}")
    if missing := [n for n in names or [] if n not in found]:
        raise ValueError(f"the table in {path} lacks {missing}; it has {found}")
    return long.groupBy("date").pivot("name", names or found).agg(F.first("value"))
