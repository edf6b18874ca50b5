"""Streams that come out of order, in several micro-batches, against what the whole gives."""

import datetime as dt
import glob
import random
import types

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barsmith import core
from barsmith.plans import table_queries
from barsmith.sources import storage
from barsmith.streaming import bars as stream

T0 = dt.datetime(2024, 1, 1)
TICK = "trade long, ts timestamp_ntz, symbol string, price double"


def feed(spark, batches, tie="trade"):
    """A stream that takes each list of (trade, second, symbol, price) as one micro-batch."""
    path = core.scratch_path(spark, "feed")
    for rows in batches:
        spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), k, p) for i, s, k, p in rows], TICK).coalesce(1).write.mode("append").parquet(path)
    return stream.tick_stream(spark, path, "symbol", "price", files=1, tie=tie)


def run(spark, df):
    work = core.scratch_path(spark, "work")
    return stream.run_to_files(df, f"{work}/out", f"{work}/checkpoint")


def test_the_tick_of_a_later_batch_that_is_earlier_in_time(spark):
    ticks = feed(spark, [[(1, 10, "A", 3.0)], [(2, 0, "A", 1.0), (3, 100, "A", 5.0)]])
    got = {r.ts.replace(tzinfo=None): r.ema for r in run(spark, stream.ema_stream(ticks, 3, "30 seconds")).collect()}
    assert got == {T0: 1.0, T0 + dt.timedelta(seconds=10): 2.0}  # the last tick may still be overtaken


@pytest.mark.parametrize("grain", [1, 7, 3600])
def test_shuffled_batches_give_the_batch_result(spark, grain):
    rng = random.Random(grain)
    rows = [(i, rng.randint(0, 600), rng.choice("AB"), float(rng.randint(1, 9))) for i in range(120)]
    come = sorted(rows, key=lambda r: r[1] + rng.random() * 60)
    batches = [come[i : i + 30] for i in range(0, 120, 30)]
    got = run(spark, stream.ema_stream(feed(spark, batches), 5, "61 seconds", grain)).toPandas().sort_values(["symbol", "ts", "seq"])
    want = pd.DataFrame(rows, columns=["seq", "s", "symbol", "price"]).sort_values(["symbol", "s", "seq"])
    want["ema"] = want.groupby("symbol")["price"].transform(lambda x: x.ewm(span=5, adjust=False).mean())
    want = want[want["s"] <= max(r[1] for r in rows) - 61]
    assert got["seq"].tolist() == want["seq"].tolist() and got["ema"].tolist() == pytest.approx(want["ema"].tolist())


def test_ticks_behind_the_watermark_are_late(spark):
    ticks = feed(spark, [[(1, 0, "A", 1.0), (2, 100, "A", 3.0)], [(3, 200, "A", 5.0)], [(4, 50, "A", 99.0), (5, 300, "A", 7.0)]])
    out = run(spark, stream.rsi_stream(ticks, 2, "10 seconds")).collect()
    assert sorted(r.seq for r in out) == [1, 2, 3]


def test_trades_of_one_time(spark):
    def bars(tie, rows):
        root, work = core.scratch_path(spark, "bars"), core.scratch_path(spark, "work")
        stream.ingest_stream(feed(spark, [rows, [(9, 7200, "A", 1.0)]], tie), root, f"{work}/rows", f"{work}/checkpoint")
        return [(r.open, r.high, r.low, r.close, r.volume) for r in storage.read_bars(spark, root).where(F.col("timestamp") == T0).collect()]

    rows = [(1, 0, "A", 10.0), (2, 0, "A", 12.0), (3, 0, "A", 9.0), (3, 0, "A", 9.0), (4, 0, "A", 9.0)]
    assert bars("trade", rows) == [(10.0, 12.0, 9.0, 9.0, 40.0)]  # trade 3 came twice, trade 4 is another one
    assert bars(None, rows) == [(9.0, 12.0, 9.0, 12.0, 31.0)]  # without ids: by price


class Held(dict):
    """State of one key that counts its calls and the bytes of ticks that pass."""

    def __init__(self):
        self.reads = self.writes = self.passed = 0

    def getValue(self, k):
        self.reads, self.passed = self.reads + 1, self.passed + len(self[k][0])
        return self[k]

    def updateValue(self, k, v):
        self.writes, self.passed = self.writes + 1, self.passed + len(v[0])
        self[k] = v

    removeKey, exists = dict.pop, dict.__len__

    def get(self):
        return self["value"]

    def update(self, v):
        self["value"] = v


@pytest.mark.parametrize("stretches", [1, 500])
def test_ticks_that_wait_are_read_once(monkeypatch, stretches):
    monkeypatch.setattr(stream, "BUFFER", 4096)
    n, rng = 20_000, np.random.default_rng(stretches)
    ts, price = rng.integers(1_000_000, stretches * 600_000_000, n), rng.random(n)
    come = pa.table({"exchange": ["x"] * n, "symbol": ["A"] * n, "ts": pa.array(ts, pa.timestamp("us", "UTC")), "price": price, "seq": np.arange(n)})
    rows = pd.concat([b.to_pandas() for b in stream._packs(iter(come.to_batches(max_chunksize=128)))])
    assert len(rows) == 4 * 32 + 29  # full rows of 128 ticks from each buffer, a last one of what is left
    frames = (rows[i : i + 3] for i in range(0, len(rows), 3))  # 384 ticks each
    states, timers = {k: Held() for k in ("waiting", "parts", "left")}, []
    handle = types.SimpleNamespace(getMapState=lambda name, *_: states[name], getValueState=lambda name, _: states[name], registerTimer=timers.append)
    ordered = stream.Ordered(lambda x, left: (x.cumsum() + (left[0] if left else 0.0), (float(x.sum() + (left[0] if left else 0.0)),)), "total", "y double")
    ordered.init(handle)
    at = lambda ms: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    list(ordered.handleInputRows(("x", "A"), frames, at(0)))
    waiting = states["waiting"]
    assert timers == [ts.min() // 1000] and waiting.reads == 0 and waiting.writes <= 5 * stretches and waiting.passed == 24 * n
    middle = int(np.sort(ts)[n // 2]) // 1000
    got = [*ordered.handleExpiredTimer(("x", "A"), at(middle), None)]
    assert timers[1:] == [ts[ts // 1000 > middle].min() // 1000]
    got = pd.concat([*got, *ordered.handleExpiredTimer(("x", "A"), at(1 << 50), None)])
    order = np.lexsort((np.arange(n), ts))
    assert got["seq"].tolist() == order.tolist() and got["total"].tolist() == pytest.approx(price[order].cumsum().tolist())
    assert not waiting and len(timers) == 2 and waiting.passed <= 24 * n * 3


def test_several_tasks_can_read_a_shuffled_file(spark, monkeypatch):
    monkeypatch.setattr(table_queries, "SHUFFLED_GROUP", 4096, raising=False)
    path = core.scratch_path(spark, "shuffled")
    monkeypatch.setattr(table_queries, "scratch_path", lambda *_: path)
    table_queries._shuffled(spark, "/root/testdata/sf0.01")
    files = [pq.ParquetFile(f) for f in glob.glob(f"{path}/*.parquet")]
    assert len(files) == table_queries.SHUFFLED_FILES and all(f.metadata.num_row_groups > 1 for f in files)
    came = spark.read.parquet(path).select("event_id", "ts", "event_type", "value")
    assert came.exceptAll(spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(*came.columns)).isEmpty() and came.count() == 10_000
