"""Bars: schema, time steps, series windows, and the recurrences that indicators share.

Every operator works on all series of a table at once. A series is one
(exchange, symbol, interval); windows are partitioned by it and ordered by time,
so stacking operators costs one shuffle in total.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

SERIES = ["exchange", "symbol", "interval"]
PRICES = ["open", "high", "low", "close"]
OHLCV = [*PRICES, "volume"]
BAR_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in SERIES] + [T.StructField("timestamp", T.TimestampNTZType())] + [T.StructField(c, T.DoubleType()) for c in OHLCV]
)

# Seconds of each time step; a month counts as 30 days.
SECONDS = {
    "1s": 1, "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600, "8h": 28800, "12h": 43200,
    "1d": 86400, "1w": 604800, "1M": 2592000,
}

#: Weights under e to the minus this are lost in double precision.
FADED = 40.0


def num(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def series(order: str = "timestamp") -> WindowSpec:
    return Window.partitionBy(*SERIES).orderBy(order)


def rows(n: int) -> WindowSpec:
    """The last ``n`` rows of the series, this one included."""
    return series().rowsBetween(-(n - 1), 0)


def upto() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def prev(x: str | Column, k: int = 1) -> Column:
    return F.lag(num(x), k).over(series())


def roll(f, x: str | Column, n: int) -> Column:
    """Aggregate over the last ``n`` rows; null until there are ``n``, and where any of them is null."""
    x = num(x)
    return F.when(F.count(x).over(rows(n)) == n, f(x).over(rows(n)))


def div(a: str | Column, b: str | Column) -> Column:
    """Quotient; null for a zero divisor."""
    return F.try_divide(num(a), num(b))


def flag(condition: Column) -> Column:
    """A comparison with null is false."""
    return F.coalesce(condition, F.lit(False))


def cum(x: str | Column) -> Column:
    return F.sum(num(x)).over(upto())


def check(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    kinds = dict(df.dtypes)
    wrong = [c for c in columns if c in (*OHLCV,) and kinds[c].split("(")[0] not in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")]
    if wrong:
        raise ValueError(f"not numeric: {', '.join(wrong)}")


def check_period(df: DataFrame, period: int, strict: bool = False) -> None:
    """A period must be positive; with ``strict`` also shorter than every series, which costs a count."""
    if period <= 0:
        raise ValueError("the period must be positive")
    if strict:
        shortest = df.groupBy(*SERIES).count().agg(F.min("count")).first()[0]
        if shortest is None or period >= shortest:
            raise ValueError("the period must be shorter than the series")


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def reach(alpha: float) -> int:
    """Values after which an exponential mean has forgotten what came before, in double precision."""
    q = 1.0 - alpha
    return 1 if q < 1e-12 else max(1, math.ceil(-FADED / math.log(q)))


# ------------------------------------------------------ exponential means

#: A mean of other means: the names it is made of, how, and alpha. The function sees arrays in a task, or columns.
Derived = tuple[tuple[str, ...], Callable, float]


def ewms(df: DataFrame, means: dict[str, tuple[str | Column, float]], adjust: bool = False, then: dict[str, Derived] | None = None) -> DataFrame:
    """Exponentially weighted means by name: (values, alpha), each y = (1 - alpha) y' + alpha x, seeded by the first value that isn't null.

    One scan over each series in time order, batch by batch with the last mean
    carried on, computes any number of means; ``then`` adds means of these means
    in the same scan. The order is the one that all indicators share, so the
    scan adds neither a sort nor a shuffle. Inside ``in_blocks`` each block is
    scanned by itself and gets its carry by a second level (see ``_carried``).

    A null repeats the last mean, and weights go by position: after a gap of g
    rows the mean before weighs (1 - alpha) ** g against alpha, normalised to
    one. With ``adjust`` the weights of all values so far are normalised.
    """
    then = then or {}
    for alpha in [m[-1] for m in (*means.values(), *then.values())]:
        if not 0 < alpha <= 1:
            raise ValueError("alpha must be in (0, 1]")
    kept = [c for c in df.columns if c not in means and c not in then]
    blocked = is_blocked(df)
    values = {n: F.when(F.col("_full"), num(x)) if blocked else num(x) for n, (x, _) in means.items()}
    df = df.withColumns({f"_x_{n}": x.cast("double") for n, x in values.items()}).withColumn("_row", F.row_number().over(series()))
    df = df.select(*[f"`{c}`" for c in kept], "_row", *[f"`_x_{n}`" for n in means])
    if blocked:
        df = _carried(df, kept, {n: alpha for n, (_, alpha) in means.items()}, adjust)
        for name, (inputs, f, alpha) in then.items():
            df = ewms(df, {name: (f(*[F.col(i) for i in inputs]), alpha)}, adjust)
        return df
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in (*means, *then)])
    alphas = {n: alpha for n, (_, alpha) in means.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = {n: MeanScan(alpha, adjust) for n, alpha in alphas.items()} | {n: MeanScan(alpha, adjust) for n, (_, _, alpha) in then.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(len(kept)).to_numpy()
            out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for i, n in enumerate(alphas):
                x = batch.column(len(kept) + 1 + i)
                out[n] = scans[n].step(at, at == 1, x.fill_null(0.0).to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False))
            for n, (inputs, f, _) in then.items():
                out[n] = scans[n].step(at, at == 1, f(*[out[i][0] for i in inputs]), np.logical_and.reduce([out[i][1] for i in inputs]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[pa.array(y, pa.float64(), mask=~known) for y, known in out.values()]], [*kept, *out])

    return df.mapInArrow(scan, schema)


class MeanScan:
    """The scan of one exponential mean over rows of series in order, batch by batch.

    A row is an affine map of the vector before it: (mean), or (sum, weight) with
    ``adjust``. Maps are joined by doubling steps, all rows of a batch at once,
    so a batch of many short series costs the same as one of a long series.
    With ``relative`` the vector tells the mean as a function of the mean f at
    the first value of the block: (B, A) for A f + B, or (B, A, weight).
    """

    def __init__(self, alpha: float, adjust: bool, relative: bool = False) -> None:
        self.alpha, self.adjust, self.relative = alpha, adjust, relative
        self.width = (3 if adjust else 2) if relative else (2 if adjust else 1)
        self.state, self.last = np.zeros(self.width), None

    def vectors(self, at: np.ndarray, start: np.ndarray, x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vector of each row, and whether its series has had a value; ``at`` are positions, ``start`` marks the first row of a series."""
        n, q = len(at), 1.0 - self.alpha
        index = np.arange(n)
        head = np.maximum.accumulate(np.where(start, index, 0))
        seen = np.maximum.accumulate(np.where(valid, index, -1))
        before = np.concatenate(([-1], seen[:-1]))
        inside = before >= head
        inside[0] = False
        last = np.where(inside, at[np.maximum(before, 0)], 0)
        if self.last is not None and not start[0]:
            # The first series of the batch goes on.
            goes = (np.cumsum(start) == 0) & ~inside
            last, inside = np.where(goes, self.last, last), inside | goes
        first = valid & ~inside
        weight = np.power(q, np.where(inside & valid, at - last, 0).astype(np.float64))
        if self.adjust:
            a, new = weight, 1.0
        else:
            share = weight + self.alpha
            a, new = weight / share, self.alpha / share
        a = np.where(valid, np.where(first, 0.0, a), np.where(start, 0.0, 1.0))
        b = np.zeros((self.width, n))
        b[0] = np.where(valid, np.where(first, 0.0 if self.relative else x, new * x), 0.0)
        if self.relative:
            b[1] = first
        if self.adjust:
            b[-1] = valid & ~first if self.relative else valid
        far, step = (reach(self.alpha) if q else 1), 1
        while step < n and (step < far or not valid.all()):
            # Where a is 0 nothing before counts, not even what isn't finite.
            back = np.where(a[step:] == 0.0, 0.0, b[:, :-step])
            b[:, step:] += a[step:] * back
            a[step:] *= a[:-step]
            a[np.abs(a) < 1e-300] = 0.0
            if not a[step:].any():
                break
            step *= 2
        if self.last is not None and not start[0]:
            b += np.where(a == 0.0, 0.0, a * self.state[:, None])
        known = (seen >= head) | ((np.cumsum(start) == 0) & (self.last is not None))
        self.state = b[:, -1].copy()
        self.last = (at[seen[-1]] if seen[-1] >= head[-1] else self.last if not start.any() else None) if known[-1] else None
        return b, known

    def step(self, at: np.ndarray, start: np.ndarray, x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, known = self.vectors(at, start, x, valid)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (b[0] / b[1] if self.adjust else b[0]), known


def _carried(df: DataFrame, kept: list[str], alphas: dict[str, float], adjust: bool) -> DataFrame:
    """Means over blocks: each block tells its means as functions of the first one, and a table of one row a block carries values on.

    The mean at a block's first value follows from the mean that the block
    before had reached where this block (with its history) begins, and from how
    many rows ago its last value was.
    """
    width = 3 if adjust else 2
    parts = {n: [f"_b_{n}_{i}" for i in range(width)] for n in alphas}
    xs = [f"_x_{n}" for n in alphas]
    new = [T.StructField(p, T.DoubleType()) for n in alphas for p in parts[n]]
    schema = T.StructType([df.schema[c] for c in [*kept, *xs]] + new)
    at_column, held_columns = df.columns.index("_at"), [df.columns.index(c) for c in [*kept, *xs]]
    row_column, x_columns = df.columns.index("_row"), [df.columns.index(x) for x in xs]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = {n: MeanScan(alpha, adjust, relative=True) for n, alpha in alphas.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            at, start, out = batch.column(at_column).to_numpy(), batch.column(row_column).to_numpy() == 1, []
            for n, i in zip(alphas, x_columns, strict=True):
                x = batch.column(i)
                b, known = scans[n].vectors(at, start, x.fill_null(0.0).to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False))
                out += [pa.array(row, pa.float64(), mask=~known) for row in b]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in held_columns], *out], [f.name for f in schema.fields])

    rows_ = written(df.mapInArrow(scan, schema), "means")
    hand, ends = F.col("_hand"), []
    for n in alphas:
        x = F.col(f"_x_{n}")
        ends += [F.min_by(x, F.when(x.isNotNull(), F.col("_at"))).alias(f"xf_{n}"), F.min(F.when(x.isNotNull(), F.col("_at"))).alias(f"pf_{n}"), F.max(F.when(hand & x.isNotNull(), F.col("_at"))).alias(f"pl_{n}")]
        ends += [F.max_by(F.when(hand, F.col(p)), F.when(hand, F.col("_at"))).alias(f"v{i}_{n}") for i, p in enumerate(parts[n])]
    own = ["_exchange", "symbol", "interval"]
    ends = rows_.groupBy(*own, "_block", "exchange").agg(*ends)
    carries = T.StructType([ends.schema[c] for c in ("exchange", "symbol", "interval")] + [T.StructField(f"{k}_{n}", T.DoubleType()) for n in alphas for k in (("n0", "w0", "nf", "wf") if adjust else ("n0", "nf"))])

    def chain(table: pa.Table) -> pa.Table:
        """Of one series: what each block starts from (n0, w0) and its first mean (nf, wf). One short row for each block."""
        rows = sorted(table.to_pylist(), key=lambda r: r["_block"])
        for n, alpha in alphas.items():
            value, mass, last = None, None, None
            for r in rows:
                r[f"n0_{n}"], r[f"w0_{n}"] = value, mass
                first, place = r[f"xf_{n}"], r[f"pf_{n}"]
                if place is None:
                    r[f"nf_{n}"] = r[f"wf_{n}"] = None
                    continue
                if value is None:
                    nf, wf = first, 1.0
                else:
                    held = (1.0 - alpha) ** (place - last)
                    nf, wf = (held * value + first, held * mass + 1.0) if adjust else ((held * value + alpha * first) / (held + alpha), 1.0)
                r[f"nf_{n}"], r[f"wf_{n}"] = nf, wf
                if r[f"pl_{n}"] is not None:
                    value, last = r[f"v1_{n}"] * nf + r[f"v0_{n}"], r[f"pl_{n}"]
                    mass = r[f"v1_{n}"] * wf + r[f"v2_{n}"] if adjust else 1.0
        return pa.table({f.name: pa.array([r[f.name] for r in rows], pa.string() if i < 3 else pa.float64()) for i, f in enumerate(carries.fields)})

    started = ends.groupBy(*own).applyInArrow(chain, carries)
    key = F.struct(*SERIES)
    joined = rows_.withColumn("_key", key).join(started.select(key.alias("_key"), *[c for c in started.columns if c not in SERIES]), "_key", "left")
    means = []
    for n in alphas:
        b = [F.col(p) for p in parts[n]]
        whole = b[1] * F.col(f"nf_{n}") + b[0]
        begun = F.col(f"n0_{n}")
        if adjust:
            whole, begun = whole / (b[1] * F.col(f"wf_{n}") + b[2]), begun / F.col(f"w0_{n}")
        means.append(F.when(b[1].isNull(), begun).otherwise(whole).alias(n))
    return joined.select(*[f"`{c}`" for c in kept], *means)


def framed(df: DataFrame, wanted: dict[str, tuple[str | Column, int, Callable[[np.ndarray], np.ndarray]]]) -> DataFrame:
    """Functions of the last n values of each series, by name: (values, n, f); null until there are n, and where any of them is null.

    ``f`` gets a matrix, one row of n values (oldest first) for each row of a
    batch, and gives one number a row. For what no aggregate of a frame tells;
    a task holds a batch and the n - 1 rows before it.
    """
    kept = [c for c in df.columns if c not in wanted]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in wanted])
    df = df.withColumns({f"_x_{n}": num(x).cast("double") for n, (x, _, _) in wanted.items()}).withColumn("_row", F.row_number().over(series()))
    df = df.select(*[f"`{c}`" for c in kept], "_row", *[f"`_x_{n}`" for n in wanted])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {name: (np.empty(0), np.empty(0, dtype=bool)) for name in wanted}
        for batch in batches:
            if not batch.num_rows:
                continue
            at, out = batch.column(len(kept)).to_numpy(), []
            for i, (name, (_, n, f)) in enumerate(wanted.items()):
                column = batch.column(len(kept) + 1 + i)
                x = np.concatenate([held[name][0], column.fill_null(0.0).to_numpy(zero_copy_only=False)])
                valid = np.concatenate([held[name][1], column.is_valid().to_numpy(zero_copy_only=False)])
                y, full, far = np.zeros(len(at)), np.zeros(len(at), dtype=bool), len(x) - len(at)
                if len(x) >= n:
                    upto_ = np.concatenate(([0], np.cumsum(valid)))
                    whole, ends = upto_[n:] - upto_[:-n] == n, np.arange(n - 1, len(x)) - far
                    use = np.flatnonzero(whole & (ends >= 0))
                    use = use[at[ends[use]] >= n]
                    frames = np.lib.stride_tricks.sliding_window_view(x, n)
                    for part in np.array_split(use, max(1, len(use) * n >> 20)):
                        y[ends[part]] = f(frames[part])
                    full[ends[use]] = True
                out.append(pa.array(y, pa.float64(), mask=~full))
                held[name] = x[len(x) - min(len(x), n - 1) :], valid[len(x) - min(len(x), n - 1) :]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *out], [*kept, *wanted])

    return df.mapInArrow(scan, schema)


def ewm(df: DataFrame, x: str | Column, alpha: float, name: str, adjust: bool = False) -> DataFrame:
    return ewms(df, {name: (x, alpha)}, adjust)


def ema(df: DataFrame, x: str | Column, span: int, name: str, adjust: bool = False) -> DataFrame:
    return ewms(df, {name: (x, span_alpha(span))}, adjust)


def emas(df: DataFrame, means: dict[str, tuple[str | Column, int]], adjust: bool = False, then: dict[str, tuple[tuple[str, ...], Callable, int]] | None = None) -> DataFrame:
    """Several exponential means by span, and means of them, in one scan."""
    return ewms(df, {n: (x, span_alpha(span)) for n, (x, span) in means.items()}, adjust, {n: (of, f, span_alpha(span)) for n, (of, f, span) in (then or {}).items()})


# ------------------------------------------------------------ long series

#: Rows of a block, and steps of a time block.
BLOCK = 1 << 16
#: Rows of one series above which presets work in blocks.
LONG = 1_000_000


def step_seconds(column: str = "interval") -> Column:
    """Seconds of the time step; null for unknown ones."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in SECONDS.items() for x in kv]), F.col(column)).cast("long")


def time_block(size: int = BLOCK, time: str = "timestamp") -> Column:
    """Which stretch of ``size`` time steps a row lies in. As a series has a bar a step, such a block of a series has ``size`` rows at most."""
    return F.floor(epoch_ms(time) / (F.coalesce(step_seconds(), F.lit(1)) * 1000 * size))


def positions(df: DataFrame, name: str = "_at", size: int = BLOCK) -> DataFrame:
    """Row numbers 0, 1, 2 ... of each series in time order, in two levels, so that a long series is spread over many tasks.

    Rows are numbered inside time blocks; a table of one row for each block sums
    the counts before it. Rows of one time are numbered in no certain order.
    """
    held = df.withColumn("_key", F.struct(*SERIES, time_block(size).alias("_tb")))
    sizes = held.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*[f"_key.{c}" for c in SERIES]).orderBy("_key._tb").rowsBetween(Window.unboundedPreceding, -1))
    held = held.join(sizes.select("_key", F.coalesce(before, F.lit(0)).alias("_before")), "_key")
    inside = F.row_number().over(Window.partitionBy("_key").orderBy("timestamp"))
    return held.withColumn(name, F.col("_before") + inside - 1).drop("_key", "_before")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it as often as they like, and a lost executor costs its task."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_blocked(df: DataFrame) -> bool:
    return "_hand" in df.columns


def running(df: DataFrame, sums: dict[str, str | Column]) -> DataFrame:
    """Running sums from the start of each series, by name; null until there is a value.

    Inside ``in_blocks`` they are sums of each block plus those of all blocks
    before, which a table of one row for each block adds up.
    """
    if not is_blocked(df):
        return df.withColumns({n: cum(x) for n, x in sums.items()})
    local = written(df.withColumns({n: cum(F.when(F.col("_full"), num(x))) for n, x in sums.items()}), "sums")
    own = ["_exchange", "symbol", "interval"]
    ends = local.where("_hand").groupBy(*own, "_block").agg(*[F.max_by(n, "_at").alias(f"_end_{n}") for n in sums])
    # What block b has summed where block b + 1 begins is carried into b + 1.
    upto_b = Window.partitionBy(*own).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    carry = ends.select(F.struct(*own, (F.col("_block") + 1).alias("_block")).alias("_key"), *[F.sum(f"_end_{n}").over(upto_b).alias(f"_end_{n}") for n in sums])
    out = local.withColumn("_key", F.struct(*own, "_block")).join(carry, "_key", "left")
    both = {n: F.coalesce(F.col(n) + F.col(f"_end_{n}"), F.col(n), F.col(f"_end_{n}")) for n in sums}
    return out.withColumns(both).select(*[f"`{c}`" for c in df.columns if c not in sums], *sums)


def in_blocks(df: DataFrame, f: Callable[[DataFrame], DataFrame], history: int, size: int = BLOCK) -> DataFrame:
    """``f(df)`` for series too long for one task: blocks of ``size`` rows, each with twice the ``history`` rows before it.

    ``f`` adds columns by windows that look back ``history`` rows at most and not
    ahead, by exponential means (``ewms``) and by sums from the start
    (``running``): both carry their values from block to block, so they need no
    history of their own. They begin ``history`` rows before the block, where
    what they are taken from is known in full, so windows over them are right too. Positions come from ``positions``, so no task sees a
    whole series. Inside ``f`` a block is a series of its own.
    """
    if history < 0 or size < 1:
        raise ValueError("history must not be negative, and size must be positive")
    held = positions(df)
    home = F.floor(F.col("_at") / size)
    held = held.withColumn("_block", F.explode(F.sequence(home, F.floor((F.col("_at") + 2 * history) / size))))
    held = held.withColumn("_own", F.col("_block") == home).withColumn("_full", F.col("_at") >= F.col("_block") * size - history)
    held = held.withColumn("_hand", F.col("_full") & (F.col("_at") < (F.col("_block") + 1) * size - history))
    held = held.withColumn("_exchange", F.col("exchange")).withColumn("exchange", F.concat_ws("\u0000", F.col("_block").cast("string"), "exchange"))
    out = f(held).where("_own").withColumn("exchange", F.col("_exchange"))
    return out.drop("_own", "_exchange", "_at", "_block", "_full", "_hand")


def spread(df: DataFrame, f: Callable[[DataFrame], DataFrame], history: int, limit: int = LONG) -> DataFrame:
    """``f(df)``, in blocks if a series has more than ``limit`` rows; one aggregate counts them."""
    if is_blocked(df):
        return f(df)
    longest = df.groupBy(*SERIES).count().agg(F.max("count")).first()[0] or 0
    return in_blocks(df, f, history) if longest > limit else f(df)


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3.0


def true_range() -> Column:
    last = prev("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))


def bars_from_ticks(ticks: DataFrame, symbol: str, price: str, step: str, time: str = "ts", tie: str | None = None, volume: str | None = None, exchange: str | Column = "local") -> DataFrame:
    """Bars of all symbols from single prices: one aggregation, partial on the map side.

    ``tie`` orders prices of the same time. Empty steps are left out (see ``densify``).
    """
    start = bucket(F.col(time), step)
    order = F.col(time) if tie is None else F.struct(time, tie)
    named = ticks.select((F.lit(exchange) if isinstance(exchange, str) else exchange).alias("exchange"), F.col(symbol).alias("symbol"), F.lit(step).alias("interval"), start.alias("timestamp"), F.col(price).cast("double").alias("_p"), F.col(volume or price).cast("double").alias("_v"), order.alias("_o"))
    return named.groupBy(*SERIES, "timestamp").agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_o").alias("close"), F.sum("_v").alias("volume")
    )


def bucket(time: Column, step: str) -> Column:
    """Start of the time step that holds a TIMESTAMP_NTZ; weeks begin on Monday."""
    if step not in SECONDS:
        raise ValueError(f"unknown time step: {step}")
    unit = {"1d": "day", "1w": "week", "1M": "month", "1h": "hour", "1m": "minute", "1s": "second"}.get(step)
    if unit:
        return F.date_trunc(unit, time).cast("timestamp_ntz")
    return F.window(time, f"{SECONDS[step]} seconds")["start"]


def epoch_ms(time: str | Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), num(time))


def from_ms(ms: str | Column) -> Column:
    """TIMESTAMP_NTZ in UTC from milliseconds, whatever the session's zone."""
    return F.timestamp_add("MILLISECOND", num(ms), F.lit("1970-01-01").cast("timestamp_ntz"))


def scratch_path(spark, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or a temporary one where that is unset and Spark runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="barsmith-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
