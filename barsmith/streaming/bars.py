"""Structured Streaming over ticks and bars: ingest, bars from ticks, running means in event-time order."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..core import SECONDS, SERIES
from ..sources import storage


def tick_stream(spark: SparkSession, path: str, symbol: str, price: str, time: str = "ts", exchange: str = "local", files: int | None = None, tie: str | None = None) -> DataFrame:
    """Ticks (exchange, symbol, ts, price, seq) of Parquet files, as they come, at most ``files`` in one micro-batch.

    ``tie`` is a whole number that tells ticks of one time apart and orders them,
    such as a trade's id; without it ``seq`` is 0. Times become zoned in UTC, as
    watermarks need it.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    raw = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)
    seq = F.lit(0) if tie is None else F.col(tie)
    return raw.select(F.lit(exchange).alias("exchange"), F.col(symbol).alias("symbol"), F.to_utc_timestamp(F.col(time).cast("timestamp"), F.current_timezone()).alias("ts"), F.col(price).cast("double").alias("price"), seq.cast("long").alias("seq"))


def bar_stream(ticks: DataFrame, step: str, delay: str | None = "10 minutes") -> DataFrame:
    """Bars of closed steps in append mode; ticks later than ``delay`` are dropped. None: the ticks have a watermark.

    Ticks of one time are ordered by ``seq``, then price.
    """
    at, order = F.window("ts", f"{SECONDS[step]} seconds"), F.struct("ts", "seq", "price")
    g = (ticks if delay is None else ticks.withWatermark("ts", delay)).groupBy("exchange", "symbol", at.alias("_w"))
    bars = g.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("price").alias("volume"))
    return bars.select("exchange", "symbol", F.lit(step).alias("interval"), F.col("_w.start").cast("timestamp_ntz").alias("timestamp"), "open", "high", "low", "close", "volume")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all there is, exactly once, into Parquet files, and read them."""
    with _rocksdb(stream.sparkSession):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def ingest_stream(ticks: DataFrame, root: str, scratch: str, checkpoint: str, delay: str = "10 minutes") -> None:
    """Ticks as bars of 1s: repeated ticks within the watermark go, a second is written when it is closed, each micro-batch into the months it touches.

    A tick is repeated if time, ``seq`` and price are the same, so trades of one
    time at different prices all count, and those of one price do if ``seq``
    tells them apart. A batch that is run again writes the same rows, so
    restarts do no harm.
    """
    bars = bar_stream(ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["exchange", "symbol", "ts", "seq", "price"]), "1s", None)

    def merge(batch: DataFrame, number: int) -> None:
        storage.upsert(batch.sparkSession, root, batch, f"{scratch}/{number}")

    bars.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which ordered state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


# ----------------------------------------------------------- ordered state

#: Seconds of event time that are buffered, and later sorted, together. Shorter ones take less memory and more steps.
GRAIN = 600

#: Ticks that are packed, or put into the state, at once, and ticks of a packed row at most: a frame holds up to 10,000 such rows.
BUFFER, PACK = 1 << 19, 128

#: Values of ticks in order, and what the ticks before have left: the new values, and what is left now.
Step = Callable[[np.ndarray, tuple | None], tuple[np.ndarray, tuple]]

# Ticks are packed as a matrix of whole numbers, kept as bytes: a row of times (us), a row of ``seq``, a row of the bits of prices.


def _unpacked(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(p, np.int64).reshape(3, -1) for p in parts], axis=1)


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    ends = [*(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
    return zip([0, *ends[:-1]], ends, strict=True)


def _pack(ticks: pa.Table) -> pa.RecordBatch:
    ticks = ticks.filter(pc.is_valid(ticks["ts"])).combine_chunks()
    if not len(ticks):
        return pa.RecordBatch.from_pydict({"exchange": pa.array([], pa.string()), "symbol": pa.array([], pa.string()), "ticks": pa.array([], pa.binary())})
    exchange, symbol = (ticks[c].chunk(0).dictionary_encode("encode") for c in ("exchange", "symbol"))
    code = exchange.indices.to_numpy().astype(np.int64) * len(symbol.dictionary) + symbol.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    price = pc.fill_null(ticks["price"], float("nan")).to_numpy()
    matrix = np.stack([ticks["ts"].cast(pa.int64()).to_numpy(), pc.fill_null(ticks["seq"], 0).to_numpy(), price.view(np.int64)])[:, order]
    starts, rows = [], []
    for a, z in _runs(code[order]):
        for i in range(a, z, PACK):
            starts.append(order[i])
            rows.append(matrix[:, i : min(i + PACK, z)].tobytes())
    keys = ticks.select(["exchange", "symbol"]).take(pa.array(starts)).combine_chunks()
    return pa.RecordBatch.from_pydict({"exchange": keys["exchange"].chunk(0), "symbol": keys["symbol"].chunk(0), "ticks": pa.array(rows, pa.binary())})


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ticks of each symbol in rows of up to PACK, as the state operator takes every row by itself in Python. Those without a time go, a missing ``seq`` is 0."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BUFFER:
            yield _pack(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _pack(pa.Table.from_batches(held))


class Ordered(StatefulProcessor):
    """Puts the ticks of a symbol in event-time order and runs a step over them.

    Ticks come and wait packed: a map goes from stretches of event time and
    numbers of parts to the ticks of each part, so that neither the state nor a
    frame ever holds a symbol's whole stream. Ticks that come add parts; those
    that wait aren't read again until the watermark passes and a timer has all
    stretches up to it sorted (by time, then ``seq``, then price) and stepped
    through one after another. Ticks at or before the watermark of the
    micro-batch in which they come are late and dropped.
    """

    def __init__(self, step: Step, name: str, state: str, grain: int = GRAIN) -> None:
        self.run, self.name, self.state, self.grain = step, name, state, grain * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stretch long, part long", "ticks binary")
        self.parts = handle.getValueState("parts", "number long")
        self.left = handle.getValueState("left", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, first, held, n = timerValues.getCurrentWatermarkInMs(), None, [], 0
        part = self.parts.get()[0] if self.parts.exists() else 0
        for frame in rows:
            came = _unpacked(frame["ticks"].tolist())
            held.append(came[:, came[0] // 1000 > mark])
            n += held[-1].shape[1]
            if n >= BUFFER:
                part, first = part + 1, self._add(held, part + 1, first)
                held, n = [], 0
        if n:
            part, first = part + 1, self._add(held, part + 1, first)
        if first is not None:
            self.parts.update((part,))
            self.handle.registerTimer(first)
        return iter(())

    def _add(self, held: list[np.ndarray], part: int, first: int | None) -> int:
        """Let ticks wait as a new part of their stretches; the first time (ms) of these and ``first``."""
        ticks = np.concatenate(held, axis=1)
        stretch = ticks[0] // self.grain
        order = np.argsort(stretch, kind="stable")
        ticks, stretch = ticks[:, order], stretch[order]
        for a, z in _runs(stretch):
            self.waiting.updateValue((int(stretch[a]), part), (ticks[:, a:z].tobytes(),))
        low = int(ticks[0].min()) // 1000
        return low if first is None else min(low, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, later, ready, n = timerValues.getCurrentWatermarkInMs(), None, [], 0
        for s, parts in itertools.groupby(sorted(tuple(k) for k in self.waiting.keys()), lambda k: k[0]):
            if s * self.grain // 1000 > mark:
                later = s * self.grain // 1000
                break
            held = []
            for k in parts:
                held.append(self.waiting.getValue(k)[0])
                self.waiting.removeKey(k)
            ticks = _unpacked(held)
            ticks = ticks[:, np.lexsort((ticks[2].view(float), ticks[1], ticks[0]))]
            due = int(np.searchsorted(ticks[0] // 1000, mark, side="right"))
            if due < ticks.shape[1]:
                self.waiting.updateValue((s, 0), (ticks[:, due:].tobytes(),))  # parts that come have numbers from 1
                later = int(ticks[0, due]) // 1000
            if due:
                ready.append(ticks[:, :due])
                n += due
            if n >= BUFFER // 4:
                yield self._stepped(key, ready)
                ready, n = [], 0
            if later is not None:
                break
        if n:
            yield self._stepped(key, ready)
        if later is not None:
            self.handle.registerTimer(later)

    def _stepped(self, key, ready: list[np.ndarray]) -> pd.DataFrame:
        ts, seq, price = np.concatenate(ready, axis=1)
        price = price.view(float)
        out, left = self.run(price, tuple(self.left.get()) if self.left.exists() else None)
        self.left.update(left)
        return pd.DataFrame({"exchange": key[0], "symbol": key[1], "ts": pd.to_datetime(ts, unit="us"), "price": price, "seq": seq, self.name: out})

    def close(self) -> None:
        pass


def _ordered(ticks: DataFrame, step: Step, name: str, state: str, delay: str, grain: int) -> DataFrame:
    out = f"exchange string, symbol string, ts timestamp, price double, seq long, {name} double"
    keys = [F.col(c).cast("string").alias(c) for c in ("exchange", "symbol")]
    packed = ticks.withWatermark("ts", delay).select(*keys, "ts", "price", "seq").mapInArrow(_packs, "exchange string, symbol string, ticks binary")
    return packed.groupBy("exchange", "symbol").transformWithStateInPandas(Ordered(step, name, state, grain), out, "Append", "EventTime")


def _means(x: np.ndarray, before: float | None, alpha: float) -> np.ndarray:
    """Exponential means of values that go on from the mean ``before``."""
    held = x if before is None else np.concatenate(([before], x))
    return pd.Series(held).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(held) - len(x) :]


def ema_stream(ticks: DataFrame, span: int, delay: str = "0 seconds", grain: int = GRAIN) -> DataFrame:
    """Running exponential mean of the price of each symbol in event-time order; a tick comes out when the watermark has passed it.

    ``delay`` is how late a tick may come: with 0 seconds none may come later than
    a tick of an earlier micro-batch. Other state than the last mean is the ticks
    that wait.
    """
    alpha = 2.0 / (span + 1.0)

    def step(x: np.ndarray, held: tuple | None) -> tuple[np.ndarray, tuple]:
        y = _means(x, held and held[0], alpha)
        return y, (float(y[-1]),)

    return _ordered(ticks, step, "ema", "y double", delay, grain)


def rsi_stream(ticks: DataFrame, period: int = 14, delay: str = "0 seconds", grain: int = GRAIN) -> DataFrame:
    """Running relative strength (span weights) of each symbol in event-time order; the state is the last price and both means, and ticks that wait."""
    alpha = 2.0 / (period + 1.0)

    def step(x: np.ndarray, held: tuple | None) -> tuple[np.ndarray, tuple]:
        moves = np.diff(x, prepend=x[0] if held is None else held[0])
        gain = _means(np.maximum(moves, 0.0), held and held[1], alpha)
        loss = _means(np.maximum(-moves, 0.0), held and held[2], alpha)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where((loss == 0) & (gain > 0), 100.0, 100.0 - 100.0 / (1.0 + gain / loss))
        return np.where(np.isnan(out), None, out), (float(x[-1]), float(gain[-1]), float(loss[-1]))

    return _ordered(ticks, step, "rsi", "price double, gain double, loss double", delay, grain)


def newest_bars(df: DataFrame, since: DataFrame) -> DataFrame:
    """Bars after the last stored one of each series."""
    high = since.groupBy(*SERIES).agg(F.max("timestamp").alias("_high"))
    return df.join(high, SERIES, "left").where(F.col("_high").isNull() | (F.col("timestamp") > F.col("_high"))).drop("_high")
