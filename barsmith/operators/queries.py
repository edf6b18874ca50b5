"""Selecting, ranking, aggregating and resampling bars."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import BLOCK, OHLCV, SECONDS, SERIES, bucket, div, epoch_ms, from_ms, positions, prev, scratch_path

# ------------------------------------------------------------- selection


def moment(t: str | Column) -> Column:
    """A UTC time from ISO text: ``T`` or space, with ``Z``, an offset, or nothing."""
    text = F.lit(t) if isinstance(t, str) else t
    return F.to_utc_timestamp(F.regexp_replace(F.regexp_replace(text, " T", "T"), r" ([+-]\d\d:?\d\d)$", "$1").cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


def in_range(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows of the closed range; if the table has year and month columns, months outside are never read."""
    if start is not None:
        df = df.where(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    if {"year", "month"} <= set(df.columns):
        at = F.col("year") * 12 + F.col("month")
        for limit, keep in ((start, at.__ge__), (end, at.__le__)):
            if limit is not None:
                df = df.where(keep(int(limit[:4]) * 12 + int(limit[5:7])))
    return df


def select_bars(df: DataFrame, exchange: str | None = None, symbol: str | None = None, interval: str | None = None, start: str | None = None, end: str | None = None, columns: list[str] | None = None, filters: tuple[Callable[[DataFrame], DataFrame], ...] = ()) -> DataFrame:
    """Bars of the chosen series and closed time range; ``filters`` are applied in order, then ``columns``."""
    for name, value in (("exchange", exchange), ("symbol", symbol), ("interval", interval)):
        if value is not None:
            df = df.where(F.col(name) == value)
    df = in_range(df, start, end)
    for f in filters:
        df = df.transform(f)
    return df.select(*columns) if columns else df


def where_text(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which an expression such as ``close > 50 and volume > 100`` holds; bad text raises."""
    return df.where(F.expr(condition))


def newest(df: DataFrame, n: int, order: str = "timestamp") -> DataFrame:
    """The last ``n`` rows of every series. Spark keeps only ``n`` rows of a series in each task before the shuffle."""
    w = Window.partitionBy(*SERIES).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def oldest(df: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy(*SERIES).orderBy("timestamp")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top(df: DataFrame, n: int = 10, by: str = "volume", ascending: bool = False) -> DataFrame:
    """The ``n`` largest (smallest) rows of each series; ties keep the earliest, nulls come last."""
    x = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    w = Window.partitionBy(*SERIES).orderBy(x, "timestamp")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def price_changes(df: DataFrame, threshold: float | None = None) -> DataFrame:
    df = df.withColumn("price_change", 100 * div(F.col("close") - prev("close"), prev("close"))).withColumn("price_diff", F.col("close") - prev("close"))
    return df if threshold is None else df.where(F.abs("price_change") >= threshold)


def latest_within(df: DataFrame, now: str, days: int = 30, limit: int = 1000) -> DataFrame:
    end = F.lit(now).cast("timestamp_ntz")
    return newest(df.where((F.col("timestamp") <= end) & (F.col("timestamp") >= end - F.expr(f"INTERVAL {days} DAYS"))), limit)


def closed_before(df: DataFrame, time: str, limit: int) -> DataFrame:
    """The newest ``limit`` closed bars: start + step is not after ``time``; looks back limit x step x 1.2."""
    step = F.element_at(F.create_map(*[F.lit(x) for kv in SECONDS.items() for x in kv]), F.col("interval"))
    at, ms = epoch_ms(F.lit(time).cast("timestamp_ntz")), epoch_ms("timestamp")
    kept = df.where((ms + step * 1000 <= at) & (ms >= at - F.floor(step * limit * 1.2) * 1000))
    return newest(kept, limit)


def before(df: DataFrame, time: str, limit: int) -> DataFrame:
    """``closed_before`` with times in milliseconds."""
    return closed_before(df, time, limit).withColumn("timestamp", epoch_ms("timestamp"))


def records(df: DataFrame, limit: int) -> DataFrame:
    return newest(df, limit).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


def valid_keys(df: DataFrame, exchanges: tuple[str, ...] | None = None) -> DataFrame:
    """Adds base, quote and key_ok: known step, BASE/QUOTE symbol, known exchange if a list is given."""
    parts = F.split("symbol", "/")
    ok = F.col("interval").isin(*SECONDS) & (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.coalesce(F.get(parts, F.lit(1)), F.lit("")) != "")
    if exchanges:
        ok = ok & F.col("exchange").isin(*exchanges)
    return df.withColumn("base", F.split_part("symbol", F.lit("/"), F.lit(1))).withColumn("quote", F.split_part("symbol", F.lit("/"), F.lit(2))).withColumn("key_ok", F.coalesce(ok, F.lit(False)))


@dataclass(frozen=True)
class BarQuery:
    """A lazily built query; every step returns a new one.

    >>> BarQuery(bars).symbol("BTC/USDT").between("2024-01-01", "2024-02-01").where("close > open").limit(10).execute()
    """

    table: DataFrame
    keys: dict[str, str] = field(default_factory=dict)
    span: tuple[str | None, str | None] = (None, None)
    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    names: tuple[str, ...] = ()
    head: int | None = None

    def exchange(self, value: str) -> BarQuery:
        return replace(self, keys=self.keys | {"exchange": value})

    def symbol(self, value: str) -> BarQuery:
        return replace(self, keys=self.keys | {"symbol": value})

    def interval(self, value: str) -> BarQuery:
        return replace(self, keys=self.keys | {"interval": value})

    def between(self, start: str | None, end: str | None) -> BarQuery:
        return replace(self, span=(start, end))

    def filter(self, f: Callable[[DataFrame], DataFrame]) -> BarQuery:
        return replace(self, steps=(*self.steps, f))

    def where(self, condition: str) -> BarQuery:
        return self.filter(lambda df: where_text(df, condition))

    def columns(self, *names: str) -> BarQuery:
        return replace(self, names=names)

    def limit(self, n: int) -> BarQuery:
        return replace(self, head=n)

    def execute(self) -> DataFrame:
        """The oldest ``limit`` rows of each chosen series, if a limit was set."""
        df = select_bars(self.table, **self.keys, start=self.span[0], end=self.span[1], filters=self.steps)
        df = df if self.head is None else oldest(df, self.head)
        return df.select(*self.names) if self.names else df

    def to_csv(self, path: str) -> None:
        self.execute().write.option("header", True).mode("overwrite").csv(path)

    def to_json(self, path: str) -> None:
        self.execute().write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS").mode("overwrite").json(path)


# ----------------------------------------------------------- aggregation


#: Missing steps that one row of the first level of a gap stands for.
CHUNK = 1 << 12


def densify(df: DataFrame, step: str, label: str = "timestamp", size: int = BLOCK) -> DataFrame:
    """All steps from the first to the last of each series; rows that are new have nulls, rows between two steps go.

    Only the gaps are filled in. Steps are numbered from the first row of a
    series and dealt to blocks of ``size`` steps; each row learns the next one
    inside its block, and a table of one row for each block knows the next block
    that has rows. A gap becomes a row for each CHUNK of its missing steps,
    these are dealt evenly, and only then become steps. So neither a row nor a
    task holds a series, and only rows that are missing are made.
    """
    if step == "1M":  # months have no fixed length, and are few
        span = df.groupBy(*SERIES).agg(F.min(label).alias("_a"), F.max(label).alias("_b"))
        grid = span.select(*SERIES, F.explode(F.sequence(F.col("_a"), F.col("_b"), F.expr("INTERVAL 1 MONTH"))).alias(label))
        return grid.join(df, [*SERIES, label], "left")
    ms = SECONDS[step] * 1000
    own = F.struct(*SERIES)
    held = df.withColumn("_series", own)
    first = held.groupBy("_series").agg(F.min(epoch_ms(label)).alias("_first"))
    held = held.join(first, "_series").withColumn("_k", epoch_ms(label) - F.col("_first")).where(F.col("_k") % ms == 0)
    held = held.withColumn("_k", F.expr(f"_k div {ms}")).withColumn("_key", F.struct("_series", F.expr(f"_k div {size}").alias("_b")))
    ends = held.groupBy("_key").agg(F.min("_k").alias("_low"))
    after = F.lead("_low").over(Window.partitionBy("_key._series").orderBy("_key._b"))
    known = held.select("_key", "_k", "_first").join(ends.select("_key", after.alias("_after")), "_key")
    following = F.coalesce(F.lead("_k").over(Window.partitionBy("_key").orderBy("_k")), F.col("_after"))
    gaps = known.select("_key", "_first", "_k", following.alias("_next")).where(F.col("_next") - F.col("_k") > 1)
    parts = gaps.withColumn("_c", F.explode(F.sequence(F.lit(0), F.expr(f"(_next - _k - 2) div {CHUNK}"))))
    # As many partitions as set: each short row becomes CHUNK rows, which adaptive merging of small partitions doesn't see.
    parts = parts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key", "_k", "_c")
    steps = F.sequence(F.col("_k") + 1 + F.col("_c") * CHUNK, F.least(F.col("_next") - 1, F.col("_k") + (F.col("_c") + 1) * CHUNK))
    new = parts.select(F.col("_key._series").alias("_series"), "_first", F.explode(steps).alias("_k"))
    new = new.select(*[F.col(f"_series.{c}").alias(c) for c in SERIES], from_ms(F.col("_first") + F.col("_k") * ms).alias(label))
    return held.select(*df.columns).unionByName(new, allowMissingColumns=True).select(*SERIES, label, *[c for c in df.columns if c not in (*SERIES, label)])


def resample(df: DataFrame, step: str, dense: bool = True) -> DataFrame:
    """Bars of a longer step: first open, highest high, lowest low, last close, summed volume; only columns that are there.

    With ``dense`` empty steps are kept, with null prices and volume 0.
    """
    rules = {
        "open": F.min_by("open", F.when(F.col("open").isNotNull(), F.col("timestamp"))),
        "high": F.max("high"),
        "low": F.min("low"),
        "close": F.max_by("close", F.when(F.col("close").isNotNull(), F.col("timestamp"))),
        "volume": F.coalesce(F.sum("volume"), F.lit(0.0)),
    }
    named = df.withColumn("_at", bucket(F.col("timestamp"), step)).withColumn("interval", F.lit(step))
    out = named.groupBy(*SERIES, "_at").agg(*[f.alias(c) for c, f in rules.items() if c in df.columns]).withColumnRenamed("_at", "timestamp")
    if not dense:
        return out
    out = densify(out, step)
    return out.withColumn("volume", F.coalesce("volume", F.lit(0.0))) if "volume" in df.columns else out


AGGREGATES = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}


def aggregated(df: DataFrame, func: str = "mean", by: str = "D") -> DataFrame:
    """All five columns by day, week (labelled by its Sunday) or month (labelled by its last day); empty ones appear, sums as 0."""
    if func not in AGGREGATES or by not in ("D", "W", "M"):
        raise ValueError(f"unknown aggregate or period: {func}, {by}")
    step = {"D": "1d", "W": "1w", "M": "1M"}[by]
    out = df.withColumn("_at", bucket(F.col("timestamp"), step)).groupBy(*SERIES, F.col("_at").alias("timestamp")).agg(*[AGGREGATES[func](c).alias(c) for c in OHLCV])
    out = densify(out, step)
    if func == "sum":
        out = out.fillna(0.0, subset=OHLCV)
    label = {"D": F.col("timestamp"), "W": F.col("timestamp") + F.expr("INTERVAL 6 DAYS"), "M": F.last_day("timestamp").cast("timestamp_ntz")}[by]
    return out.withColumn("timestamp", label)


def statistics(df: DataFrame) -> DataFrame:
    return df.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("count"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"), F.min_by("open", "timestamp").alias("open_first"), F.max_by("close", "timestamp").alias("close_last"), F.max("high").alias("high_max"),
        F.min("low").alias("low_min"), F.avg("close").alias("close_mean"), F.stddev_samp("close").alias("close_std"), F.sum("volume").alias("volume_total"), F.avg("volume").alias("volume_mean"), F.max("volume").alias("volume_max"), F.min("volume").alias("volume_min"),
    )


def period_statistics(df: DataFrame, now: str, days: int = 30) -> DataFrame:
    end = F.lit(now).cast("timestamp_ntz")
    df = df.where((F.col("timestamp") <= end) & (F.col("timestamp") >= end - F.expr(f"INTERVAL {days} DAYS")))
    df = df.withColumn("_r", div(F.col("close") - prev("close"), prev("close")))
    first, last = F.min_by("close", "timestamp"), F.max_by("close", "timestamp")
    return df.groupBy(*SERIES).agg(F.max("high").alias("high_max"), F.min("low").alias("low_min"), F.avg("close").alias("close_mean"), (100 * F.try_divide(last - first, first)).alias("change_pct"), F.sum("volume").alias("volume_total"), F.avg("volume").alias("volume_mean"), (100 * F.stddev_samp("_r")).alias("volatility_pct"))


def catalog_totals(partitions: DataFrame) -> DataFrame:
    """records, size_bytes, first and last time by exchange, symbol and interval of partition records."""
    return partitions.groupBy(*SERIES).agg(F.sum("records").alias("records"), F.sum("size_bytes").alias("size_bytes"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))


def series_listing(df: DataFrame, exchange: str | None = None) -> DataFrame:
    df = df if exchange is None else df.where(F.col("exchange") == exchange)
    return df.select("exchange", "symbol").distinct().orderBy("exchange", "symbol")


def trend_strength(df: DataFrame, column: str = "close") -> DataFrame:
    """Absolute correlation of a column with its row number; 0 below 10 rows, below 5 values, or if undefined."""
    df = positions(df, "_i")
    g = df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n"), F.count(column).alias("_k"), F.corr(F.col("_i").cast("double"), column).alias("_c"))
    value = F.when((F.col("_n") >= 10) & (F.col("_k") >= 5), F.abs(F.col("_c")))
    return g.select(*SERIES, F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0)).alias("trend_strength"))


# ---------------------------------------------------------------- chunks


def chunks(df: DataFrame, size: int) -> DataFrame:
    """``chunk_id`` of consecutive chunks of exactly ``size`` rows of each series, the last one shorter."""
    return positions(df).withColumn("chunk_id", F.floor(F.col("_at") / size)).drop("_at")


def delivered(df: DataFrame) -> DataFrame:
    """Rows with ``position``, 0, 1, 2 ... over the whole table in the order of a feed: series, then time.

    Rows are dealt by range and numbered inside each task; a table of one row
    for each task carries the numbers on, so no task sees all rows.
    """
    order = [*SERIES, "timestamp"]
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), low.alias("_at"))
    path = scratch_path(df.sparkSession, "feed")
    dealt.write.parquet(path)
    dealt = df.sparkSession.read.schema(dealt.schema).parquet(path)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each shuffle partition, so its size is bounded by that setting.
    offsets = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    return dealt.join(offsets, "_part").withColumn("position", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def iterate(df: DataFrame, size: int = 1000) -> Iterator[list[Row]]:
    """Chunks of ``size`` rows in the order of a feed, the last one shorter.

    The driver holds one partition and one chunk at a time, never the table.
    """
    if size < 1:
        raise ValueError("size must be positive")
    chunk: list[Row] = []
    for row in df.repartitionByRange(*SERIES, "timestamp").sortWithinPartitions(*SERIES, "timestamp").toLocalIterator():
        chunk.append(row)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def iterate_rows(df: DataFrame, size: int = 1000) -> Iterator[dict]:
    """Rows as dicts in the order of a feed."""
    for chunk in iterate(df, size):
        for row in chunk:
            yield row.asDict()


def chunk_statistics(df: DataFrame, size: int) -> DataFrame:
    """Chunks and rows of each series; the number of chunks follows from the rows, so no row is numbered."""
    g = df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_rows"))
    return g.select(*SERIES, F.ceil(F.col("n_rows") / size).cast("long").alias("n_chunks"), "n_rows")


def chunk_totals(df: DataFrame, size: int) -> DataFrame:
    g = chunks(df, size).groupBy(*SERIES, "chunk_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"), F.max("high").alias("high"), F.min("low").alias("low"))
    w = Window.partitionBy(*SERIES).orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return g.select(*SERIES, "chunk_id", F.sum("rows").over(w).alias("rows"), F.sum("volume").over(w).alias("volume"), F.max("high").over(w).alias("high"), F.min("low").over(w).alias("low"))
