"""The keyed service against a stub: 404, 429, failures, key ranges and resumed runs."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from ledgerline.sources import service, tables


class Stub:
    """Answers by key: GONE 404, BUSY n 429 n times, BROKEN 500, TEXT no JSON, EMPTY [], others two records."""

    def __init__(self):
        self.asked, self.times, self.busy, self.broken = Counter(), [], {"BUSY1": 1, "BUSY9": 9}, {"BROKEN"}
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                key = self.path.split("/")[2]
                stub.asked[key] += 1
                stub.times.append(time.monotonic())
                code, body = 200, json.dumps({"data": [{"date": "2020-01-02T00:00:00Z", "adjClose": 1.5, "adjVolume": 7}, {"date": "2020-01-03T00:00:00Z", "adjClose": 2, "adjVolume": None}, {"date": "2020-01-06T00:00:00Z"}]})
                if key.startswith("GONE"):
                    code, body = 404, "no"
                elif stub.busy.get(key, 0) >= stub.asked[key]:
                    code, body = 429, "slow down"
                elif key in stub.broken:
                    code, body = 500, "oops"
                elif key == "TEXT":
                    body = "<html>"
                elif key == "EMPTY":
                    body = '{"data": []}'
                self.send_response(code)
                if code == 429:
                    self.send_header("Retry-After", "0.05")
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/daily/{{key}}/prices"


@pytest.fixture
def stub():
    s = Stub()
    yield s
    s.server.shutdown()


FAST = {"per_second": 1000, "records": "data", "timeout": 5}


def test_statuses(spark, stub):
    keys = ["A", "B/C", "GONE", "BUSY1", "BUSY9", "BROKEN", "TEXT", "EMPTY"]
    got = service.prices(spark, stub.url, keys, partitions=3, **FAST).collect()
    by = {k: [(str(r.date), r.close, r.volume) for r in got if r.ticker == k and r.status == "ok"] for k in keys}
    two = [("2020-01-02", 1.5, 7.0), ("2020-01-03", 2.0, None)]  # a record without any value is none
    assert by["A"] == by["BUSY1"] == by["B/C"] == two and not any(by[k] for k in keys if k not in ("A", "BUSY1", "B/C"))
    rest = {r.ticker: (r.status, r.error) for r in got if r.status != "ok"}
    assert rest["GONE"] == rest["EMPTY"] == ("missing", None) and rest["BUSY9"] == ("failed", "HTTP 429") and rest["BROKEN"] == ("failed", "HTTP 500")
    assert rest["TEXT"][0] == "failed" and "JSON" in rest["TEXT"][1] and len(got) == 3 * 2 + 5
    assert stub.asked["GONE"] == 1 and stub.asked["BUSY1"] == stub.asked["BUSY9"] == 2


def test_no_server(spark):
    got = service.prices(spark, "http://127.0.0.1:9/{key}", ["A"], **FAST).collect()
    assert [(r.status, r.close) for r in got] == [("failed", None)] and "refused" in got[0].error
    assert service.prices(spark, "http://127.0.0.1:9/{key}", [], **FAST).collect() == []


def test_rate_and_ranges(spark, stub):
    keys = [f"K{k:02d}" for k in range(20)]
    df = service.prices(spark, stub.url, keys, partitions=4, records="data", per_second=20, pause_every=0)
    assert df.rdd.getNumPartitions() == 4
    df.count()
    took = sorted(stub.times)
    assert len(took) == 20 and took[-1] - took[0] >= 4 * 4 / 20 - 0.05  # five requests a range, each a fifth of a second apart
    pace = service.Pace(0.0, 2, 0.05)
    began = time.monotonic()
    for _ in range(5):
        pace.wait()
    assert 0.09 < time.monotonic() - began < 0.5


def test_settings_are_checked(spark, stub):
    for options in ({"per_second": 0}, {"key": "nope"}):
        with pytest.raises(Exception, match="per_second|no column"):
            service.prices(spark, stub.url, ["A"], **options).collect()
    with pytest.raises(Exception, match="schema"):
        spark.dataSource.register(service.KeyedService)
        spark.read.format("keyed_service").option("url", "x").option("keys", "[]").load().collect()


def test_resumed_runs(spark, stub, tmp_path):
    keys = spark.createDataFrame([("A",), ("GONE",), ("BROKEN",), ("B",), ("B",), (None,)], "ticker string")
    schema = "ticker string, date date, close double"
    options = {"url": stub.url, "fields": {"close": "adjClose"}, "batch": 2} | FAST
    path = f"{tmp_path}/store"
    assert service.fetch_resumed(spark, keys, path, schema, **options) == 4
    store = spark.read.parquet(path)
    assert {r.ticker: r.error for r in store.where("status = 'failed'").collect()} == {"BROKEN": "HTTP 500"}
    stub.broken.clear()
    more = keys.union(spark.createDataFrame([("NEW",)], "ticker string"))
    assert service.fetch_resumed(spark, more, path, schema, **options) == 2  # what failed, and what is new
    assert service.fetch_resumed(spark, more, path, schema, **options) == 0
    assert stub.asked == {"A": 1, "B": 1, "GONE": 1, "BROKEN": 2, "NEW": 1}
    got = service.current(spark.read.parquet(path), "ticker")
    assert sorted((r.ticker, str(r.date), r.close) for r in got.collect()) == sorted((t, d, c) for t in ("A", "B", "BROKEN", "NEW") for d, c in (("2020-01-02", 1.5), ("2020-01-03", 2.0)))


def test_an_interrupted_run_loses_one_batch(spark, stub, tmp_path, monkeypatch):
    keys = spark.createDataFrame([(f"K{k}",) for k in range(9)], "ticker string")
    path, schema = f"{tmp_path}/store", "ticker string, date date, close double"
    options = {"url": stub.url, "fields": {"close": "adjClose"}, "batch": 3} | FAST
    real, calls = service.read_service, []

    def dies(*a, **b):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(*a, **b)

    monkeypatch.setattr(service, "read_service", dies)
    with pytest.raises(RuntimeError):
        service.fetch_resumed(spark, keys, path, schema, **options)
    monkeypatch.setattr(service, "read_service", real)
    assert service.fetch_resumed(spark, keys, path, schema, **options) == 6
    got = service.current(spark.read.parquet(path), "ticker")
    assert got.count() == 18 and got.select("ticker").distinct().count() == 9 and max(stub.asked.values()) == 1


def test_fetch_missing_asks_failures_again(spark):
    cache = spark.createDataFrame([("a", "1")], "k string, v string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")

    def fetch(k):
        if k == "c":
            raise OSError("429")
        return ("2",) if k == "b" else None

    once = tables.fetch_missing(keys, cache, "k", fetch)
    assert sorted(map(tuple, once.collect())) == [("a", "1"), ("b", "2"), ("d", None)]
    again = tables.fetch_missing(keys, spark.createDataFrame(once.collect(), cache.schema), "k", lambda k: (k.upper(),))
    assert sorted(map(tuple, again.collect()))[2] == ("c", "C")
