"""Cleaning and grading of bars, all series in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import OHLCV, PRICES, SECONDS, SERIES, check, div, flag, from_ms, prev, series, written

COMPLETE, GOOD = 0.99, 0.95
MAX_DUPLICATES = 0.01


def seconds_of(step: str | Column = "interval") -> Column:
    """Seconds of a time step, from its name in a column."""
    column = F.col(step) if isinstance(step, str) else step
    return F.element_at(F.create_map(*[F.lit(x) for kv in SECONDS.items() for x in kv]), column).cast("double")


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def valid_bar() -> Column:
    """The row invariants of a bar; null prices fail."""
    o, h, l, c, v = (F.col(x) for x in OHLCV)
    return flag((h >= l) & (h >= o) & (h >= c) & (l <= o) & (l <= c)) & (F.coalesce(v, F.lit(0.0)) >= 0)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(valid_bar()), df.where(~valid_bar())


def clean(df: DataFrame, sequence: str = "ingest_seq") -> DataFrame:
    """Valid bars, one for each time: texts are cast, rows without time or price and with high < low go, prices are corrected.

    ``sequence`` orders the input; of equal times the last row stays. Times may
    be milliseconds or TIMESTAMP_NTZ. Negative volume becomes 0; null volume stays.
    """
    check(df, *SERIES, "timestamp")
    kinds = dict(df.dtypes)
    if kinds["timestamp"] in ("bigint", "int", "double"):
        df = df.withColumn("timestamp", from_ms(F.col("timestamp").cast("long")))
    elif kinds["timestamp"] != "timestamp_ntz":
        df = df.withColumn("timestamp", F.col("timestamp").try_cast("timestamp_ntz"))
    for c in OHLCV:
        x = F.col(c).try_cast("double")
        df = df.withColumn(c, F.when(~F.isnan(x), x))
    df = df.dropna(subset=["timestamp", *PRICES]).where("high >= low")
    df = df.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close"), "volume": F.when(F.col("volume") < 0, 0.0).otherwise(F.col("volume"))})
    # Without a sequence the row that stays is the largest by its values, so reruns agree.
    order = F.col(sequence).desc() if sequence in df.columns else F.struct("close", "volume", *[c for c in OHLCV if c not in ("close", "volume")]).desc()
    w = Window.partitionBy(*SERIES, "timestamp").orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def clean_counts(df: DataFrame) -> DataFrame:
    """How many rows each cleaning rule touches, for each series."""
    bad = F.col("timestamp").isNull()
    for c in PRICES:
        bad = bad | F.col(c).try_cast("double").isNull()
    o, h, l, c, v = (F.col(x).try_cast("double") for x in OHLCV)
    return df.groupBy(*SERIES).agg(
        F.count_if(bad).alias("dropped_null"), F.count_if(~bad & (h < l)).alias("dropped_high_low"), F.count_if(~bad & (h >= l) & ((h < F.greatest(o, c)) | (l > F.least(o, c)))).alias("corrected"), F.count_if(v < 0).alias("negative_volume")
    )


def completeness(df: DataFrame) -> DataFrame:
    """rows, first, last and completeness: rows over the steps from first to last, 1 at most."""
    g = df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))
    span = seconds_between(F.col("first_time"), F.col("last_time"))
    return g.withColumn("completeness", F.least(F.lit(1.0), F.col("rows") / (F.floor(span / seconds_of()) + 1)))


def gaps(df: DataFrame) -> DataFrame:
    """One row for each pair of neighbours further apart than a step: gap_start and gap_end are the rows that exist."""
    df = df.select(*SERIES, "timestamp").withColumn("gap_start", prev("timestamp"))
    df = df.withColumn("gap_seconds", seconds_between(F.col("gap_start"), F.col("timestamp")))
    return df.where(F.col("gap_seconds") > seconds_of()).select(*SERIES, "gap_start", F.col("timestamp").alias("gap_end"), "gap_seconds")


def data_quality(df: DataFrame) -> DataFrame:
    """completeness and duplicate_rate; the distinct times are counted after a partial aggregation by time."""
    each = df.groupBy(*SERIES, "timestamp").agg(F.count(F.lit(1)).alias("_n"))
    g = each.groupBy(*SERIES).agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("_distinct"), F.min("timestamp").alias("_a"), F.max("timestamp").alias("_b"))
    steps = F.floor(seconds_between(F.col("_a"), F.col("_b")) / seconds_of()) + 1
    return g.select(*SERIES, "rows", F.least(F.lit(1.0), F.col("rows") / steps).alias("completeness"), ((F.col("rows") - F.col("_distinct")) / F.col("rows")).alias("duplicate_rate"))


def thresholds(df: DataFrame) -> DataFrame:
    q = data_quality(df)
    return q.withColumn("complete_ok", F.col("completeness") >= GOOD).withColumn("duplicates_ok", F.col("duplicate_rate") <= MAX_DUPLICATES)


def anomalies(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    """z-scores of price change and volume over the whole series, and whether they pass the threshold."""
    df = df.withColumn("price_change", div(F.col("close") - prev("close"), prev("close")))
    stats = df.groupBy(*SERIES).agg(*[f(c).alias(f"_{n}_{c}") for c in ("price_change", "volume") for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    df = df.join(stats, SERIES)
    for c in ("price_change", "volume"):
        z = F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.lit(0.0))
        df = df.withColumn(f"{c}_zscore", z).withColumn(f"{c}_anomaly", flag(F.abs(F.col(f"{c}_zscore")) > threshold))
    return df.drop(*[f"_{n}_{c}" for c in ("price_change", "volume") for n in "ms"])


#: A sketch of bounded size brackets a quantile: ranks are off by at most one in so many rows.
ACCURACY = 5000


#: Values of a series up to which one task may sort them.
SHORT = 100_000


def quantiles(df: DataFrame, column: str, ends: tuple[float, ...] = (0.25, 0.75)) -> DataFrame:
    """``_series`` (a struct of the series keys) and ``_q``: exact quantiles of a column, between ranks by proportion; series without values don't appear.

    A selection in two scans, all series at once. A sketch gives for each
    quantile two values between which it lies; then rows below them are only
    counted, and only values between, counted by value, meet in a window. So no
    task sees the values of a long series. Where a bracket turns out to miss its
    rank (a sketch promises less after merging), those series are sorted.
    """
    out = written(_selected(df, column, ends), "quantiles")
    missed = out.where("_q IS NULL").select("_series")
    if missed.limit(1).count():
        rows = df.where(F.col(column).isNotNull()).withColumn("_series", F.struct(*SERIES)).join(missed, "_series", "left_semi")
        again = rows.groupBy("_series").agg(F.percentile(F.col(column).cast("double"), F.array(*map(F.lit, ends))).alias("_q"))
        out = out.where("_q IS NOT NULL").unionByName(again)
    return out


def _selected(df: DataFrame, column: str, ends: tuple[float, ...]) -> DataFrame:
    """``quantiles``, null where a bracket missed."""
    rows = df.where(F.col(column).isNotNull()).select(F.struct(*SERIES).alias("_series"), F.col(column).cast("double").alias("_v"))
    marks = [min(max(e + d, 0.0), 1.0) for e in ends for d in (-2.0 / ACCURACY, 2.0 / ACCURACY)]
    sketch = rows.groupBy("_series").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, marks)), ACCURACY).alias("_m"))
    v, m = F.col("_v"), F.col("_m")
    near = [F.when((v >= m[2 * i]) & (v <= m[2 * i + 1]), F.struct(F.lit(i).alias("i"), v.alias("v"))).when(v < m[2 * i], F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("v"))) for i in range(len(ends))]
    seen = rows.join(sketch, "_series").select("_series", "_n", F.explode(F.filter(F.array(*near), lambda p: p.isNotNull())).alias("_p"))
    counts = seen.groupBy("_series", F.col("_p.i").alias("_i"), F.col("_p.v").alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    upto = Window.partitionBy("_series", "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_c").over(upto))
    place = F.element_at(F.array(*map(F.lit, ends)), F.col("_i") + 1) * (F.col("_n") - 1)
    low, high = F.floor(place), F.ceil(place)
    found = counts.groupBy("_series", "_i", "_n").agg(
        F.min(F.when(F.col("_upto") > low, F.col("_v"))).alias("_low"), F.min(F.when(F.col("_upto") > high, F.col("_v"))).alias("_high"), (F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_upto"))), F.lit(0)) <= F.min(low)).alias("_in")
    )
    between = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((high - place) * F.col("_low") + (place - low) * F.col("_high"))
    found = found.withColumn("_q", F.when(F.col("_in"), between))
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"])
    out = found.groupBy("_series").agg(sorted_.alias("_q"))
    return out.withColumn("_q", F.when((F.size("_q") == len(ends)) & ~F.exists("_q", lambda x: x.isNull()), F.col("_q")))


def remove_outliers(df: DataFrame, method: str = "iqr", factor: float = 1.5, columns: tuple[str, ...] = tuple(OHLCV), accuracy: int | None = None) -> DataFrame:
    """Drop outliers column after column; each column's limits come from the rows that the ones before have left.

    The bars are written once, so a step reads only the series keys and the
    columns that it and the steps before it check. Limits of all steps stand in
    one table with a row for each series. Quartiles are exact: sorted where no
    series has more than SHORT rows, and by ``quantiles`` otherwise; with
    ``accuracy`` they are estimated by a sketch.
    """
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unknown method: {method}")
    bars, limits, keep = written(df, "bars"), None, F.lit(True)

    short = method == "iqr" and (bars.groupBy(*SERIES).count().agg(F.max("count")).first()[0] or 0) <= SHORT

    def left() -> DataFrame:
        rows = bars.withColumn("_series", F.struct(*SERIES))
        return rows if limits is None else rows.join(limits, "_series").where(keep)

    for i, c in enumerate(columns):
        a, z = f"_a{i}", f"_z{i}"

        def limited(q: DataFrame) -> DataFrame:
            span = F.col("_q")[1] - F.col("_q")[0]
            q = q.select("_series", (F.col("_q")[0] - factor * span).alias(a), (F.col("_q")[1] + factor * span).alias(z))
            return written(q if limits is None else limits.join(q, "_series"), "limits")

        if method == "zscore":
            q = left().groupBy("_series").agg(F.avg(c).alias(a), F.stddev_samp(c).alias(z))
            limits, more = written(q if limits is None else limits.join(q, "_series"), "limits"), ~flag(F.col(z) > 0) | (F.abs(F.col(c) - F.col(a)) / F.col(z) < factor)
        else:
            ends, more = F.array(F.lit(0.25), F.lit(0.75)), (F.col(c) >= F.col(a)) & (F.col(c) <= F.col(z))
            if accuracy is not None:
                limits = limited(left().groupBy("_series").agg(F.percentile_approx(c, ends, accuracy).alias("_q")))
            elif short:
                limits = limited(left().groupBy("_series").agg(F.percentile(c, ends).alias("_q")))
            else:
                found = limited(_selected(left(), c, (0.25, 0.75)))
                limits = limited(quantiles(left(), c)) if found.where(F.col(a).isNull()).limit(1).count() else found
        keep = keep & more
    return left().select(*df.columns)


def covers_range(df: DataFrame, start: str, end: str) -> DataFrame:
    g = df.groupBy(*SERIES).agg(F.min("timestamp").alias("_a"), F.max("timestamp").alias("_b"))
    return g.select(*SERIES, ((F.col("_a") >= F.lit(start).cast("timestamp_ntz")) & (F.col("_b") <= F.lit(end).cast("timestamp_ntz"))).alias("in_range"))


def quality_report(df: DataFrame) -> DataFrame:
    """rows, completeness, gaps and status of every series, in one pass over the series' windows."""
    df = df.select(*SERIES, "timestamp").withColumn("_apart", seconds_between(prev("timestamp"), F.col("timestamp")))
    g = df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("_a"), F.max("timestamp").alias("_b"), F.count_if(F.col("_apart") > seconds_of()).alias("gaps"))
    full = F.least(F.lit(1.0), F.col("rows") / (F.floor(seconds_between(F.col("_a"), F.col("_b")) / seconds_of()) + 1))
    g = g.withColumn("completeness", full)
    return g.withColumn("status", F.when(F.col("completeness") >= COMPLETE, "excellent").when(F.col("completeness") >= GOOD, "good").otherwise("repair")).drop("_a", "_b")


def report_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("n_series"), F.avg("completeness").alias("mean_completeness"), F.sum("gaps").alias("total_gaps"))


def rating(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Grades for completeness, duplicates and anomalies of every series."""
    bad = anomalies(df, threshold).groupBy(*SERIES).agg((F.count_if("price_change_anomaly") + F.count_if("volume_anomaly")).alias("_bad"))
    q = data_quality(df).join(bad, SERIES).withColumn("anomaly_rate", F.col("_bad") / F.col("rows"))

    def grade(value: Column, best: Column, fair: Column) -> Column:
        return F.when(best, "excellent").when(fair, "good").otherwise("poor")

    c, d, a = F.col("completeness"), F.col("duplicate_rate"), F.col("anomaly_rate")
    return q.withColumns({"completeness_grade": grade(c, c >= 0.99, c >= 0.95), "duplicate_grade": grade(d, d < 0.01, d < 0.05), "anomaly_grade": grade(a, a < 0.01, a < 0.05)}).drop("_bad")


def repair_plan(df: DataFrame) -> DataFrame:
    """Gaps of series whose completeness is below 0.99."""
    poor = completeness(df).where(F.col("completeness") < COMPLETE).select(*SERIES)
    return gaps(df).join(poor, SERIES, "left_semi")


def reconcile(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Series whose stored first and last times differ from the catalog (start_time, end_time) by more than a step, or that one side lacks."""
    actual = df.groupBy(*SERIES).agg(F.min("timestamp").alias("actual_start"), F.max("timestamp").alias("actual_end"))
    joined = actual.join(catalog.select(*SERIES, "start_time", "end_time"), SERIES, "full_outer")
    off = F.greatest(F.abs(seconds_between(F.col("actual_start"), F.col("start_time"))), F.abs(seconds_between(F.col("actual_end"), F.col("end_time"))))
    status = F.when(F.col("actual_start").isNull(), "missing_data").when(F.col("start_time").isNull(), "missing_catalog").when(off > seconds_of(), "mismatch")
    return joined.withColumn("status", status).where("status is not null")


def price_violations(df: DataFrame) -> DataFrame:
    """For each series the codes of the price rules that some row breaks."""
    o, h, l, c = (F.col(x) for x in PRICES)
    low, rules = F.least(*PRICES), {}
    rules["negative_price"] = low < 0
    rules["zero_price"] = (o == 0) | (h == 0) | (l == 0) | (c == 0)
    rules["high_below_low"] = h < l
    rules["high_below_open_close"] = h < F.greatest(o, c)
    rules["low_above_open_close"] = l > F.least(o, c)
    g = df.groupBy(*SERIES).agg(*[F.coalesce(F.bool_or(r), F.lit(False)).alias(k) for k, r in rules.items()])
    codes = F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in rules]), lambda x: x.isNotNull())
    return g.select(*SERIES, codes.alias("violations"), (F.size(codes) == 0).alias("valid"))


def high_low_report(df: DataFrame) -> DataFrame:
    h, l, c = F.col("high"), F.col("low"), F.col("close")
    return df.groupBy(*SERIES).agg(F.count_if(h < l).alias("high_below_low"), F.count_if((c > h) | (c < l)).alias("close_outside"), F.count_if(F.col("volume") < 0).alias("negative_volume"))


def dataset_checks(df: DataFrame) -> DataFrame:
    """Four booleans for each series: not_null, positive_volume, valid_ohlc, chronological (no time twice)."""
    df = df.withColumn("_last", prev("timestamp"))
    nulls = F.lit(False)
    for c in OHLCV:
        nulls = nulls | F.col(c).isNull()
    return df.groupBy(*SERIES).agg(F.bool_and(~nulls).alias("not_null"), F.bool_and(flag(F.col("volume") >= 0)).alias("positive_volume"), F.bool_and(valid_bar()).alias("valid_ohlc"), F.bool_and(F.col("_last").isNull() | (F.col("_last") < F.col("timestamp"))).alias("chronological"))
