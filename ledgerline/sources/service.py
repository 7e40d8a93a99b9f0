"""A rate-limited JSON service as a Spark data source: one request a key, key ranges as partitions, failures as rows.

    spark.dataSource.register(KeyedService)
    spark.read.format("keyed_service").schema("ticker string, date date, close double") \\
        .option("url", "https://host/daily/{key}/prices").option("keys", '["A", "B"]').option("per_second", 8).load()

Each key gives its records, or one row that says why it has none: `status` is ok, missing (404, or an empty answer)
or failed, `error` names the failure. What failed is asked again by the next run, what is missing isn't.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerline.session import has_data, ship

OK, MISSING, FAILED = "ok", "missing", "failed"
STATUS = "status string, error string"
#: Adjusted prices stand under the plain names.
PRICE_FIELDS = {"date": "date", "open": "adjOpen", "high": "adjHigh", "low": "adjLow", "close": "adjClose", "volume": "adjVolume"}


@dataclass
class Keys(InputPartition):
    """A run of the sorted keys."""

    values: list[str]


@dataclass
class Pace:
    """Waits so that requests keep to a rate, with a longer pause after so many of them."""

    interval: float
    pause_every: int
    pause_seconds: float
    sent: int = 0
    last: float = 0.0

    def wait(self) -> None:
        if self.sent and self.pause_every and self.sent % self.pause_every == 0:
            time.sleep(self.pause_seconds)
        left = self.last + self.interval - time.monotonic()
        if left > 0:
            time.sleep(left)
        self.last, self.sent = time.monotonic(), self.sent + 1


def dig(record: object, path: str) -> object:
    """What stands at a dotted path of nested objects, None if there is nothing."""
    for part in filter(None, path.split(".")):
        record = record.get(part) if isinstance(record, dict) else None
    return record


def cast(value: object, kind: T.DataType) -> object:
    """A JSON value as a column's value; what doesn't fit is null."""
    try:
        if value is None:
            return None
        if isinstance(kind, T.DateType):
            return date.fromisoformat(str(value)[:10])
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else json.dumps(value)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(kind, (T.IntegerType, T.LongType)):
            return int(value)
        if isinstance(kind, T.BooleanType):
            return bool(value)
    except (TypeError, ValueError):
        return None
    raise ValueError(f"keyed_service has no columns of type {kind.simpleString()}")


class ServiceReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.names = [f.name for f in schema if f.name not in ("status", "error")]
        self.kinds = {f.name: f.dataType for f in schema}
        self.order = [f.name for f in schema]
        self.url, self.key = options["url"], options.get("key", self.names[0])
        self.keys = sorted(set(json.loads(options["keys"])))
        self.fields = json.loads(options.get("fields", "{}"))
        self.records = options.get("records", "")
        self.headers = json.loads(options.get("headers", "{}"))
        self.runs = max(1, int(options.get("partitions", "1")))
        self.per_second = float(options.get("per_second", "8"))
        self.pause_every, self.pause_seconds = int(options.get("pause_every", "400")), float(options.get("pause_seconds", "60"))
        self.retries, self.retry_seconds = int(options.get("retries", "1")), float(options.get("retry_seconds", "60"))
        self.timeout = float(options.get("timeout", "30"))
        if self.key not in self.names:
            raise ValueError(f"the schema has no column {self.key} for the key")
        if self.per_second <= 0:
            raise ValueError("per_second must be above 0")

    def partitions(self) -> list[Keys]:
        """Even runs of keys; together they keep to the rate, each having its share."""
        n = min(self.runs, len(self.keys)) or 1
        return [Keys(self.keys[len(self.keys) * k // n : len(self.keys) * (k + 1) // n]) for k in range(n)]

    def answer(self, key: str, pace: Pace) -> tuple[str, str | None, list]:
        """(status, error, records) of a key; 429 is waited out as often as retries says."""
        url = self.url.replace("{key}", urllib.parse.quote(key, safe=""))
        for attempt in range(self.retries + 1):
            pace.wait()
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=self.timeout) as r:  # noqa: S310 - the caller's URL
                    found = dig(json.load(r), self.records)
                found = found if isinstance(found, list) else [found] if found else []
                return (OK, None, found) if found else (MISSING, None, [])
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return MISSING, None, []
                if e.code == 429 and attempt < self.retries:
                    after = e.headers.get("Retry-After", "")
                    time.sleep(float(after) if after.replace(".", "", 1).isdigit() else self.retry_seconds)
                    continue
                return FAILED, f"HTTP {e.code}", []
            except (OSError, ValueError) as e:  # no connection, time-out, or an answer that is no JSON
                return FAILED, f"{type(e).__name__}: {e}"[:500], []
        return FAILED, "HTTP 429", []

    def read(self, partition: Keys) -> Iterator[tuple]:
        n = min(self.runs, len(self.keys)) or 1
        pace = Pace(n / self.per_second, -(-self.pause_every // n), self.pause_seconds)
        for key in partition.values:
            status, error, records = self.answer(key, pace)
            rows = [{c: cast(dig(r, self.fields.get(c, c)), self.kinds[c]) for c in self.names if c != self.key} for r in records]
            rows = [r for r in rows if any(v is not None for c, v in r.items() if not isinstance(self.kinds[c], T.DateType))]  # a date alone is no record
            if status == OK and not rows:
                status = MISSING
            for r in rows or [dict.fromkeys(self.names)]:
                r |= {self.key: cast(key, self.kinds[self.key]), "status": status, "error": error}
                yield tuple(r[c] for c in self.order)


class KeyedService(DataSource):
    """Options: url (with {key}), keys (a JSON list), key (column; the first), fields (JSON: column to dotted path),
    records (dotted path to the list), headers (JSON), partitions, per_second, pause_every, pause_seconds, retries,
    retry_seconds, timeout. The schema is the caller's and has the columns status and error."""

    @classmethod
    def name(cls) -> str:
        return "keyed_service"

    def schema(self) -> str:
        raise ValueError("keyed_service needs a schema with the key, the fields, status and error")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ServiceReader(schema, dict(self.options))


def read_service(spark: SparkSession, schema: str, **options: object) -> DataFrame:
    """schema's columns (the key first), status and error of the keys that options name; see KeyedService."""
    ship(spark)
    spark.dataSource.register(KeyedService)
    reader = spark.read.format("keyed_service").schema(f"{schema}, {STATUS}")
    for k, v in options.items():
        reader = reader.option(k, v if isinstance(v, str) else json.dumps(v))
    return reader.load()


def settled(store: DataFrame, key: str) -> DataFrame:
    """The keys that need no asking any more."""
    return store.where(F.col("status").isin(OK, MISSING)).select(key).distinct()


def current(store: DataFrame, key: str) -> DataFrame:
    """The records of a store that several runs appended to: of keys that were asked again, those of the last run; no failures."""
    last = store.where(F.col("status") != FAILED).groupBy(key).agg(F.max("run").alias("run"))
    return store.where(F.col("status") == OK).join(last, [key, "run"], "left_semi").drop("status", "error", "run")


def fetch_resumed(spark: SparkSession, keys: DataFrame, path: str, schema: str, batch: int = 400, most: int = 100_000, **options: object) -> int:
    """Asks for the keys (first column) that the store at path hasn't settled, and appends what comes, batch by batch.

    An interrupted run loses one batch of requests at most: the next one asks for that batch and for what failed. The
    driver holds at most `most` keys a run, which a rate-limited service can't answer in hours; the rest follow in the
    next run. Returns the number of keys asked.
    """
    key = keys.columns[0]
    wanted = keys.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()
    run = 0
    if has_data(spark, path):
        store = spark.read.parquet(path)
        run = (store.agg(F.max("run")).first()[0] or 0) + 1
        wanted = wanted.join(settled(store, key).select(F.col(key).cast("string").alias(key)), key, "left_anti")
    todo = [r[0] for r in wanted.orderBy(key).limit(most).collect()]
    for at in range(0, len(todo), batch):
        got = read_service(spark, schema, keys=todo[at : at + batch], **options)
        got.withColumn("run", F.lit(run)).write.mode("append").parquet(path)
    return len(todo)


def prices(spark: SparkSession, url: str, keys: list[str], **options: object) -> DataFrame:
    """(ticker, date, open, high, low, close, volume, status, error) of a price service's daily adjusted prices."""
    return read_service(spark, "ticker string, date date, open double, high double, low double, close double, volume double", url=url, keys=keys, fields=PRICE_FIELDS, **options)
