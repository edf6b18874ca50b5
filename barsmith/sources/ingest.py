"""Loading bars from raw exchange rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import OHLCV, SERIES, epoch_ms, from_ms
from ..operators import quality, ranges
from . import storage


def parse_rows(df: DataFrame, raw: str = "raw", end_ms: int | None = None) -> DataFrame:
    """Bars from arrays [milliseconds, open, high, low, close, volume] (array<double> or JSON text of one or many); later rows than ``end_ms`` go."""
    kind = dict(df.dtypes)[raw]
    if kind == "string":
        nested = F.from_json(F.when(F.col(raw).startswith("[["), F.col(raw)).otherwise(F.concat(F.lit("["), F.col(raw), F.lit("]"))), "array<array<double>>")
        df = df.withColumn(raw, F.explode(nested))
    cols = [from_ms(F.get(raw, F.lit(0)).cast("long")).alias("timestamp"), *[F.get(raw, F.lit(i + 1)).alias(c) for i, c in enumerate(OHLCV)]]
    out = df.select(*SERIES, *cols)
    return out if end_ms is None else out.where(epoch_ms("timestamp") <= end_ms)


def load(spark: SparkSession, raw_bars: DataFrame, root: str, scratch: str) -> DataFrame:
    """Clean, merge into the stored months, and return their records."""
    return storage.upsert(spark, root, quality.clean(raw_bars).drop("ingest_seq"), scratch)


def only_missing(bars: DataFrame, gaps: DataFrame, bin_ms: int = ranges.BIN) -> DataFrame:
    """Bars inside missing ranges (series keys, missing_start, missing_end). Ranges are merged and cut at time bins, where bars meet those of their own bin only."""
    g = ranges.merge(gaps.select(*SERIES, F.col("missing_start").alias("start"), F.col("missing_end").alias("end")), 1)
    g = g.select(*[F.col(k).alias(f"_{k}") for k in SERIES], "start", "end").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bin_ms), F.floor(F.col("end") / bin_ms))))
    ms = epoch_ms("timestamp")
    on = [F.col(k) == F.col(f"_{k}") for k in SERIES]
    return bars.join(g, [*on, F.floor(ms / bin_ms) == F.col("_b"), ms >= F.col("start"), ms <= F.col("end")], "left_semi")


def reload(spark: SparkSession, raw_bars: DataFrame, root: str, start: str, end: str, scratch: str) -> DataFrame:
    storage.delete_range(spark, root, start, end, f"{scratch}/deleted")
    return load(spark, raw_bars, root, f"{scratch}/loaded")


def newer(bars: DataFrame, held: DataFrame, now: Column, least_seconds: int = 60) -> DataFrame:
    """Bars after the last stored one of their series; series less than ``least_seconds`` behind ``now`` are skipped."""
    high = held.groupBy(*SERIES).agg(F.max("timestamp").alias("_high"))
    df = bars.join(high, SERIES, "left")
    behind = F.col("_high").isNull() | (F.timestamp_diff("SECOND", F.col("_high"), now) >= least_seconds)
    return df.where(behind & (F.col("_high").isNull() | (F.col("timestamp") > F.col("_high")))).drop("_high")


def expected_records(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Expected number of bars of each request and the share of its span that is held."""
    step = ranges.step_ms()
    want = requests.withColumn("expected", F.floor((F.col("request_end") - F.col("request_start")) / step))
    gone = ranges.missing(held, requests).groupBy(*SERIES, "request_start", "request_end").agg(F.sum(F.col("missing_end") - F.col("missing_start") + 1).alias("_gone"))
    joined = want.join(gone, [*SERIES, "request_start", "request_end"], "left")
    return joined.withColumn("progress", 1.0 - F.coalesce("_gone", F.lit(0)) / (F.col("request_end") - F.col("request_start") + 1)).drop("_gone")


def earliest(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*SERIES).agg(F.min("timestamp").alias("earliest"))
