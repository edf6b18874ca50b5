"""Queries of storage, selection, aggregation, quality, coverage, ingest, streams and recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import SERIES, bars_from_ticks, div, epoch_ms, from_ms, prev, roll, scratch_path, written
from ..operators import client
from ..operators import indicators as I
from ..operators import quality as C
from ..operators import queries as Q
from ..operators import ranges as R
from ..sources import catalog, ingest, storage
from ..streaming import bars as stream
from .indicator_queries import D1, MACD, RSI, ATR
from .tables import D, H, OVER, add, daily, hourly, layers, on_bars, rows, sdiv, sema, shown, shown_sql, slag, sroll

OHLCV = "open high low close volume"
KEY = ("symbol", "timestamp")


def simple(name: str, f, sql: str, cols: str, keys: tuple[str, ...] = KEY, days: bool = False, digits: int = 6) -> None:
    """A query whose SQL is written after the bars: ``{cols}`` stands for the rounded columns."""
    source = daily if days else hourly
    add(name, lambda s, sf: shown(f(source(s, sf)), cols, keys, digits), (D if days else H) + " " + sql.replace("{cols}", shown_sql(cols, keys, digits)))


# ---------------------------------------------------------------- storage


def stored(spark: SparkSession, sf: str, days: bool = True) -> str:
    """Write the bars of a table month by month and return the folder."""
    root = scratch_path(spark, "bars")
    storage.write_bars(daily(spark, sf) if days else hourly(spark, sf), root)
    return root


def _read_range(spark: SparkSession, sf: str) -> DataFrame:
    return shown(storage.read_range(spark, stored(spark, sf), "orders", "2-HIGH", "1996-03-05 00:00:00", "1996-07-20 00:00:00", "1d"), OHLCV)


RANGE = " SELECT {cols} FROM b WHERE symbol = '2-HIGH' AND timestamp BETWEEN '1996-03-05' AND '1996-07-20'"
add("s1_read_range", _read_range, D + RANGE.replace("{cols}", shown_sql(OHLCV)))


def _pruned(spark: SparkSession, sf: str) -> DataFrame:
    df = Q.in_range(storage.read_bars(spark, stored(spark, sf)), "1996-03-05 00:00:00", "1996-07-20 00:00:00")
    return df.groupBy("symbol", "year", "month").agg(F.count(F.lit(1)).alias("rows"))


add("s2_month_pruning", _pruned, D + " SELECT symbol, year(timestamp)::INT AS year, month(timestamp)::INT AS month, count(*) AS rows FROM b WHERE timestamp BETWEEN '1996-03-05' AND '1996-07-20' GROUP BY ALL")


def _minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Event prices as 1m bars with a first row of the month that may stand for the whole month."""
    ticks = bars_from_ticks(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "value", "1m", exchange="events")
    return storage.without_summary_rows(ticks)


M = H.replace("date_trunc('hour', ts)", "date_trunc('minute', ts)").replace("'1h'", "'1m'")
AHEAD = "OVER (PARTITION BY symbol, date_trunc('month', timestamp) ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
add(
    "s3_summary_rows",
    lambda s, sf: shown(_minutes(s, sf), OHLCV),
    M
    + f", x AS (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('month', timestamp) ORDER BY timestamp) AS rn, count(*) OVER (PARTITION BY symbol, date_trunc('month', timestamp)) AS n, avg(volume) {AHEAD} AS v5, avg(close) {AHEAD} AS c5 FROM b)"
    + f" SELECT {shown_sql(OHLCV)} FROM x WHERE NOT (rn = 1 AND n >= 6 AND (volume > 100 * v5 OR (c5 <> 0 AND abs(close - c5) / abs(c5) > 0.1)))",
)
add("s4_read_file", lambda s, sf: storage.read_file(s, f"{sf}/events.parquet", ["event_id", "ts", "value"]), "SELECT event_id, ts, value FROM events")
NOW = "2024-01-25 12:00:00"
simple("s5_read_latest", lambda b: storage.latest(b, NOW, 50), f", x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rn FROM b WHERE timestamp <= '{NOW}' AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS) SELECT {{cols}} FROM x WHERE rn <= 50".replace("{{", "{").replace("}}", "}"), OHLCV)
add("s6_read_by_date", lambda s, sf: shown(storage.read_by_date(s, stored(s, sf, False), "events", "click", "2024-01-10", "1h"), OHLCV), H + f" SELECT {shown_sql(OHLCV)} FROM b WHERE symbol = 'click' AND timestamp >= '2024-01-10' AND timestamp < '2024-01-11'")
add("s7_available_dates", lambda s, sf: storage.months_held(daily(s, sf)).select("symbol", F.col("month_start").cast("timestamp_ntz").alias("month_start")), D + " SELECT DISTINCT symbol, date_trunc('month', timestamp)::TIMESTAMP AS month_start FROM b")


def _legacy(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "legacy")
    b = storage.with_months(hourly(spark, sf))
    # A folder for each series and month, as the old layout has them; few series, so few writes.
    for r in b.select(*SERIES, "year", "month").distinct().collect():
        part = b.where((F.col("symbol") == r.symbol) & (F.col("year") == r.year) & (F.col("month") == r.month))
        part.drop(*SERIES, "year", "month").repartition(2, "timestamp").write.parquet(f"{root}/{r.exchange}/{r.symbol}/{r.interval}/{r.year}/{r.month:02d}")
    return shown(storage.read_legacy(spark, root), OHLCV, ("exchange", "symbol", "interval", "timestamp"))


add("s8_legacy_layout", _legacy, H + f" SELECT {shown_sql(OHLCV, ('exchange', 'symbol', 'interval', 'timestamp'))} FROM b")
add("s9_write", lambda s, sf: shown(storage.read_bars(s, stored(s, sf)), OHLCV), D + f" SELECT {shown_sql(OHLCV)} FROM b")
add("s10_write_partitioned", lambda s, sf: storage.partition_records(storage.read_bars(s, stored(s, sf)).drop("year", "month")).select("symbol", "year", "month", "records", "start_time", "end_time"), D + " SELECT symbol, year(timestamp)::INT AS year, month(timestamp)::INT AS month, count(*) AS records, min(timestamp) AS start_time, max(timestamp) AS end_time FROM b GROUP BY ALL")


def _upserted(spark: SparkSession, sf: str) -> DataFrame:
    root = stored(spark, sf)
    new = daily(spark, sf).where("year(timestamp) = 1997 AND month(timestamp) <= 2").withColumn("close", F.lit(1.5))
    storage.upsert(spark, root, new, scratch_path(spark, "scratch"))
    return shown(storage.read_bars(spark, root), "open close")


add("s11_append", _upserted, D + " SELECT symbol, timestamp, round(open, 6) + 0.0 AS open, CASE WHEN year(timestamp) = 1997 AND month(timestamp) <= 2 THEN 1.5::DOUBLE ELSE round(close, 6) + 0.0 END AS close FROM b")


def _deleted(spark: SparkSession, sf: str) -> DataFrame:
    root = stored(spark, sf)
    storage.delete_range(spark, root, "1996-01-10 00:00:00", "1996-06-20 00:00:00", scratch_path(spark, "scratch"))
    return storage.read_bars(spark, root).groupBy("symbol", "year", "month").agg(F.count(F.lit(1)).alias("rows"))


add("s12_delete_range", _deleted, D + " SELECT symbol, year(timestamp)::INT AS year, month(timestamp)::INT AS month, count(*) AS rows FROM b WHERE timestamp < '1996-01-10' OR timestamp > '1996-06-20' GROUP BY ALL")


def _compacted(spark: SparkSession, sf: str) -> DataFrame:
    root = stored(spark, sf)
    storage.compact(spark, root, scratch_path(spark, "scratch"), "year = 1998")
    df = storage.read_bars(spark, root).where("year = 1998").withColumn("_file", F.col("_metadata.file_path"))
    return df.groupBy("symbol", "month").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("_file").alias("files"))


add("s13_compact", _compacted, D + " SELECT symbol, month(timestamp)::INT AS month, count(*) AS rows, 1::BIGINT AS files FROM b WHERE year(timestamp) = 1998 GROUP BY ALL")


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    # Stored first: sums of doubles that are computed twice may differ in their last bits, as rows come in another order.
    before = written(daily(spark, sf), "bars")
    after = before.withColumn("close", F.when((F.col("symbol") == "1-URGENT") & (F.col("timestamp") == F.lit("1997-05-05").cast("timestamp_ntz")), F.col("close") + 1).otherwise(F.col("close")))
    return storage.changed_partitions(after, storage.partition_records(before)).select("symbol", "year", "month")


add("s14_fingerprint", _changed, D + " SELECT symbol, 1997::INT AS year, 5::INT AS month FROM b WHERE symbol = '1-URGENT' AND timestamp = '1997-05-05'")


def _csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    Q.BarQuery(hourly(spark, sf)).where("high > low").columns("symbol", "timestamp", "close").to_csv(path)
    return spark.read.option("header", True).schema("symbol string, timestamp timestamp_ntz, close double").csv(path)


add("s15_to_csv", _csv, H + " SELECT symbol, timestamp, close FROM b WHERE high > low")


def _json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "json")
    Q.BarQuery(hourly(spark, sf)).where("high > low").columns("symbol", "timestamp", "close").to_json(path)
    return spark.read.schema("symbol string, timestamp string, close double").json(path)


add("s16_to_json", _json, H + " SELECT symbol, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.000') AS timestamp, close FROM b WHERE high > low")


def _report_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "report")
    storage.report_csv(C.quality_report(hourly(spark, sf)).select("symbol", "rows", "completeness", "gaps", "status"), path)
    return spark.read.option("header", True).schema("symbol string, rows long, completeness string, gaps long, status string").csv(path)


STEPS = "(floor(date_diff('second', min(timestamp), max(timestamp)) / 3600) + 1)"
REPORT = f""", g AS (SELECT *, date_diff('second', lag(timestamp) {OVER}, timestamp) AS apart FROM b),
r AS (SELECT symbol, count(*) AS rows, least(1.0::DOUBLE, count(*) / {STEPS}) AS completeness, count(*) FILTER (WHERE apart > 3600) AS gaps FROM g GROUP BY symbol),
q AS (SELECT *, CASE WHEN completeness >= 0.99 THEN 'excellent' WHEN completeness >= 0.95 THEN 'good' ELSE 'repair' END AS status FROM r)"""
add("s17_report_csv", _report_csv, H + REPORT + " SELECT symbol, rows, printf('%.2f%%', completeness * 100) AS completeness, gaps, status FROM q")

# -------------------------------------------------------------- selection

on_bars("q1_query", lambda b: Q.select_bars(b, symbol="click", start="2024-01-05 00:00:00", end="2024-01-20 00:00:00", filters=(lambda d: d.where("close > open"), lambda d: d.withColumn("gain", F.col("close") - F.col("open")))), [{"gain": "close - open"}], "gain close", tail="WHERE symbol = 'click' AND timestamp BETWEEN '2024-01-05' AND '2024-01-20' AND close > open")
on_bars("q2_condition", lambda b: Q.where_text(b, "close > 50 and volume > 100"), [], OHLCV, tail="WHERE close > 50 AND volume > 100")
simple("q3_top_n", lambda b: Q.top(b, 10, "volume"), ", x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC NULLS LAST, timestamp)::INT AS rank FROM b) SELECT {cols} FROM x WHERE rank <= 10", "volume !rank")
on_bars("q4_ohlc", lambda b: Q.select_bars(b, columns=["symbol", "timestamp", *OHLCV.split()]), [], OHLCV)
on_bars("q5_price_changes", lambda b: Q.price_changes(b, 50.0), [{"price_change": f"100 * {sdiv(D1, slag('close'))}", "price_diff": D1}], "price_change price_diff", tail="WHERE abs(price_change) >= 50")


def _built(b: DataFrame) -> DataFrame:
    return Q.BarQuery(b).exchange("events").symbol("view").between("2024-01-03 00:00:00", "2024-01-20 00:00:00").where("volume > 20").filter(lambda d: d.withColumn("span", F.col("high") - F.col("low"))).limit(40).columns("symbol", "timestamp", "span", "volume").execute()


simple("q6_builder", _built, ", x AS (SELECT *, high - low AS span, row_number() OVER (ORDER BY timestamp) AS rn FROM b WHERE symbol = 'view' AND timestamp BETWEEN '2024-01-03' AND '2024-01-20' AND volume > 20) SELECT {cols} FROM x WHERE rn <= 40", "span volume")


def _get_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of series that are held completely enough; others would be fetched."""
    return shown(client.get(hourly(spark, sf), "2024-01-02 00:00:00", "2024-01-08 00:00:00", interval="hourly", least=0.5), OHLCV)


def _ms(t: str):
    return epoch_ms(F.lit(t).cast("timestamp_ntz"))


ISLANDS = f""", m AS (SELECT symbol, epoch_ms(timestamp) AS ms, lag(epoch_ms(timestamp)) {OVER} AS last FROM b),
i AS (SELECT symbol, ms, sum(CASE WHEN last IS NULL OR ms - last > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ms ROWS UNBOUNDED PRECEDING) AS island FROM m),
c AS (SELECT symbol, min(ms) AS start, max(ms) AS "end", count(*) AS rows FROM i GROUP BY symbol, island),
full_ AS (SELECT symbol, min(start) AS s, max("end") AS e, least(1.0::DOUBLE, sum("end" - start + 3600000) / (max("end") - min(start) + 3600000)::DOUBLE) AS completeness FROM c GROUP BY symbol)"""
A2, Z8 = 1704153600000, 1704672000000
add("q7_get_bars", _get_bars, H + ISLANDS + f" SELECT {shown_sql(OHLCV)} FROM b WHERE timestamp BETWEEN '2024-01-02' AND '2024-01-08' AND symbol IN (SELECT symbol FROM full_ WHERE s <= {A2} AND e >= {Z8} AND completeness >= 0.5)")
NEWEST = ", x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rn FROM b) SELECT {cols} FROM x WHERE rn <= "
simple("q8_get_latest", lambda b: Q.newest(b, 30), NEWEST + "30", OHLCV)
simple("q9_before", lambda b: Q.before(b, NOW, 20), f", x AS (SELECT symbol, epoch_ms(timestamp) AS timestamp, open, close, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rn FROM b WHERE timestamp + INTERVAL 1 HOUR <= TIMESTAMP '{NOW}' AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS) SELECT {{cols}} FROM x WHERE rn <= 20".replace("{{", "{").replace("}}", "}"), "open close")
AFTER_CUT = ", c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rn FROM b), k AS (SELECT * FROM c WHERE rn <= 60)"


def _cut_sql(steps: list[dict[str, str]], cols: str) -> str:
    """Layers over the newest 60 bars: the first layer reads them instead of all bars."""
    text = layers(*steps, base="")
    return H + AFTER_CUT + text.replace("FROM b", "FROM k").format(shown_sql(cols))


add("q10_client_range", lambda s, sf: shown(client.latest(hourly(s, sf), 60, interval="60m", indicators=["SMA_20", "RSI_14"]).withColumnsRenamed({"SMA_20": "sma_20", "RSI_14": "rsi_14"}), "sma_20 rsi_14"), _cut_sql([*RSI, {"sma_20": sroll("avg", "close", 20)}], "sma_20 rsi_14"))
add("q11_client_latest", lambda s, sf: shown(client.latest(hourly(s, sf), 60, exchange="events", indicators=["BOLL_20", "MACD"]), "macd macd_signal boll_middle"), _cut_sql([*MACD, {"boll_middle": sroll("avg", "close", 20)}], "macd macd_signal boll_middle"))
simple("q12_records", lambda b: Q.records(b, 25), ", x AS (SELECT * REPLACE (strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp), row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rn FROM b) SELECT {cols} FROM x WHERE rn <= 25", OHLCV)


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderstatus").alias("exchange"), F.concat_ws("/", "o_orderpriority", F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderstatus"))).alias("symbol"), F.when(F.col("o_custkey") % 5 == 0, "7h").otherwise("1d").alias("interval"))
    return Q.valid_keys(o, ("F", "O")).groupBy("exchange", "symbol", "interval", "base", "quote", "key_ok").agg(F.count(F.lit(1)).alias("n"))


add(
    "q13_validate_keys",
    _keys,
    """WITH o AS (SELECT o_orderstatus AS exchange, concat_ws('/', o_orderpriority, CASE WHEN o_custkey % 3 > 0 THEN o_orderstatus END) AS symbol, CASE WHEN o_custkey % 5 = 0 THEN '7h' ELSE '1d' END AS interval FROM orders)
SELECT exchange, symbol, interval, split_part(symbol, '/', 1) AS base, split_part(symbol, '/', 2) AS quote, interval = '1d' AND symbol LIKE '%/%' AND exchange IN ('F', 'O') AS key_ok, count(*) AS n FROM o GROUP BY ALL""",
)


def _times(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("t", F.date_trunc("second", "ts").cast("timestamp_ntz")).withColumn("ms", epoch_ms("t"))
    text = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    return e.select("event_id", "ms", from_ms("ms").alias("back"), Q.moment(F.concat(text, F.lit("Z"))).alias("zulu"), Q.moment(F.concat(text, F.lit("+02:00"))).alias("east"), Q.moment(F.concat(F.date_format("t", "yyyy-MM-dd HH:mm:ss"), F.lit(" +01:00"))).alias("shown"))


add("q14_time_conversion", _times, "SELECT event_id, epoch_ms(date_trunc('second', ts)::TIMESTAMP) AS ms, date_trunc('second', ts)::TIMESTAMP AS back, date_trunc('second', ts)::TIMESTAMP AS zulu, date_trunc('second', ts)::TIMESTAMP - INTERVAL 2 HOURS AS east, date_trunc('second', ts)::TIMESTAMP - INTERVAL 1 HOUR AS shown FROM events")

# ------------------------------------------------------------ aggregation

WEEKS = f""", x AS (SELECT symbol, date_trunc('week', timestamp)::TIMESTAMP AS t, {", ".join(f"sum({c}) AS {c}" for c in OHLCV.split())} FROM b GROUP BY ALL),
g AS (SELECT symbol, unnest(generate_series(min(t), max(t), INTERVAL 7 DAYS)) AS t FROM x GROUP BY symbol),
y AS (SELECT g.symbol, g.t + INTERVAL 6 DAYS AS timestamp, {", ".join(f"coalesce({c}, 0) AS {c}" for c in OHLCV.split())} FROM g LEFT JOIN x USING (symbol, t))
SELECT {{cols}} FROM y""".replace("{{", "{").replace("}}", "}")
simple("a1_aggregated", lambda b: Q.aggregated(b, "sum", "W"), WEEKS, OHLCV, days=True, digits=2)
MONTHS = WEEKS.replace("'week'", "'month'").replace("INTERVAL 7 DAYS", "INTERVAL 1 MONTH").replace("g.t + INTERVAL 6 DAYS", "last_day(g.t)::TIMESTAMP").replace("sum(", "avg(").replace("coalesce(open, 0)", "open").replace("coalesce(high, 0)", "high").replace("coalesce(low, 0)", "low").replace("coalesce(close, 0)", "close").replace("coalesce(volume, 0)", "volume")
simple("a1_aggregated_months", lambda b: Q.aggregated(b, "mean", "M"), MONTHS, OHLCV, days=True)
STATS = "!count !first_time !last_time open_first close_last high_max low_min close_mean close_std volume_total volume_mean volume_max volume_min"
simple(
    "a2_statistics",
    Q.statistics,
    ", x AS (SELECT symbol, count(*) AS count, min(timestamp) AS first_time, max(timestamp) AS last_time, arg_min(open, timestamp) AS open_first, arg_max(close, timestamp) AS close_last, max(high) AS high_max, min(low) AS low_min, avg(close) AS close_mean, stddev_samp(close) AS close_std, sum(volume) AS volume_total, avg(volume) AS volume_mean, max(volume) AS volume_max, min(volume) AS volume_min FROM b GROUP BY symbol) SELECT {cols} FROM x",
    STATS,
    ("symbol",),
)


def resampled_sql(unit: str, step: str) -> str:
    return f""", x AS (SELECT symbol, {unit} AS timestamp, arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp) AS close, sum(volume) AS volume FROM b GROUP BY symbol, {unit}),
g AS (SELECT symbol, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL {step})) AS timestamp FROM x GROUP BY symbol),
y AS (SELECT symbol, timestamp, open, high, low, close, coalesce(volume, 0) AS volume FROM g LEFT JOIN x USING (symbol, timestamp)) SELECT {{cols}} FROM y""".replace("{{", "{").replace("}}", "}")


simple("a3_resample", lambda b: Q.resample(b, "4h"), resampled_sql("time_bucket(INTERVAL 4 HOURS, timestamp, TIMESTAMP '1970-01-01')", "4 HOURS"), OHLCV)
simple("a3_resample_weeks", lambda b: Q.resample(b, "1w"), resampled_sql("date_trunc('week', timestamp)::TIMESTAMP", "7 DAYS"), OHLCV, days=True, digits=2)
simple("a4_densify", lambda b: Q.densify(b, "1h"), ", g AS (SELECT symbol, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp FROM b GROUP BY symbol), y AS (SELECT symbol, timestamp, close, volume FROM g LEFT JOIN b USING (symbol, timestamp)) SELECT {cols} FROM y", "close volume")
PS = "high_max low_min close_mean change_pct volume_total volume_mean volatility_pct"
simple(
    "a5_period_statistics",
    lambda b: Q.period_statistics(b, NOW, 10),
    f", p AS (SELECT * FROM b WHERE timestamp <= '{NOW}' AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 10 DAYS), x AS (SELECT *, {sdiv(D1, slag('close'))} AS r FROM p), y AS (SELECT symbol, max(high) AS high_max, min(low) AS low_min, avg(close) AS close_mean, 100 * (arg_max(close, timestamp) - arg_min(close, timestamp)) / arg_min(close, timestamp) AS change_pct, sum(volume) AS volume_total, avg(volume) AS volume_mean, 100 * stddev_samp(r) AS volatility_pct FROM x GROUP BY symbol) SELECT @ FROM y".replace("@", "{cols}"),
    PS,
    ("symbol",),
)


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    parts = storage.partition_records(daily(spark, sf)).withColumn("size_bytes", F.col("records") * 48)
    return Q.catalog_totals(parts).drop("exchange", "interval")


add("a6_catalog_totals", _totals, D + " SELECT symbol, count(*)::BIGINT AS records, (count(*) * 48)::BIGINT AS size_bytes, min(timestamp) AS start_time, max(timestamp) AS end_time FROM b GROUP BY symbol")
add("a7_series_listing", lambda s, sf: Q.series_listing(hourly(s, sf)), H + " SELECT DISTINCT exchange, symbol FROM b")
simple("a8_trend_strength", lambda b: Q.trend_strength(b), f", x AS (SELECT *, row_number() {OVER} AS i FROM b), y AS (SELECT symbol, coalesce(abs(corr(i, close)), 0) AS trend_strength FROM x GROUP BY symbol) SELECT @ FROM y".replace("@", "{cols}"), "trend_strength", ("symbol",))

# ---------------------------------------------------------------- quality


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows with faults that depend on the event: swapped limits, text for a price, negative volume, a time twice."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    v, i = F.col("value"), F.col("event_id")
    return e.select(
        F.lit("events").alias("exchange"),
        F.col("event_type").alias("symbol"),
        F.lit("1m").alias("interval"),
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("timestamp"),
        F.when(i % 11 == 0, F.lit("bad")).otherwise(v.cast("string")).alias("open"),
        F.when(i % 7 == 0, v - 1).otherwise(v + 1).alias("high"),
        F.when(i % 13 == 0, v + 0.5).otherwise(v - 0.5).alias("low"),
        v.alias("close"),
        F.when(i % 5 == 0, -v).otherwise(v).alias("volume"),
        i.alias("ingest_seq"),
    )


DIRTY = """WITH raw AS (SELECT event_type AS symbol, event_id, date_trunc('minute', ts)::TIMESTAMP AS timestamp, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS open,
  CASE WHEN event_id % 7 = 0 THEN value - 1 ELSE value + 1 END AS high, CASE WHEN event_id % 13 = 0 THEN value + 0.5 ELSE value - 0.5 END AS low, value AS close, CASE WHEN event_id % 5 = 0 THEN -value ELSE value END AS volume FROM events)"""
add(
    "c1_clean",
    lambda s, sf: shown(C.clean(_dirty(s, sf)), OHLCV),
    DIRTY + f", x AS (SELECT symbol, timestamp, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close, CASE WHEN volume < 0 THEN 0 ELSE volume END AS volume, row_number() OVER (PARTITION BY symbol, timestamp ORDER BY event_id DESC) AS rn FROM raw WHERE open IS NOT NULL AND high >= low) SELECT {shown_sql(OHLCV)} FROM x WHERE rn = 1",
)
add("c1_clean_counts", lambda s, sf: C.clean_counts(_dirty(s, sf)).drop("exchange", "interval"), DIRTY + " SELECT symbol, count(*) FILTER (WHERE open IS NULL) AS dropped_null, count(*) FILTER (WHERE open IS NOT NULL AND high < low) AS dropped_high_low, count(*) FILTER (WHERE open IS NOT NULL AND high >= low AND (high < greatest(open, close) OR low > least(open, close))) AS corrected, count(*) FILTER (WHERE volume < 0) AS negative_volume FROM raw GROUP BY symbol")
simple("c2_completeness", C.completeness, f", x AS (SELECT symbol, count(*) AS rows, min(timestamp) AS first_time, max(timestamp) AS last_time, least(1.0::DOUBLE, count(*) / {STEPS}) AS completeness FROM b GROUP BY symbol) SELECT @ FROM x".replace("@", "{cols}"), "!rows !first_time !last_time completeness", ("symbol",))
GAPS = f", x AS (SELECT symbol, lag(timestamp) {OVER} AS gap_start, timestamp AS gap_end, date_diff('second', lag(timestamp) {OVER}, timestamp)::DOUBLE AS gap_seconds FROM b) SELECT @ FROM x WHERE gap_seconds > 3600".replace("@", "{cols}")
simple("c3_gaps", C.gaps, GAPS, "gap_seconds", ("symbol", "gap_start", "gap_end"))


def _twice(b: DataFrame) -> DataFrame:
    return b.unionByName(b.where("hour(timestamp) = 3"))


TWICE = ", t AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE hour(timestamp) = 3)"
QUALITY = TWICE + f", x AS (SELECT symbol, count(*) AS rows, least(1.0::DOUBLE, count(*) / {STEPS}) AS completeness, (count(*) - count(DISTINCT timestamp))::DOUBLE / count(*) AS duplicate_rate FROM t GROUP BY symbol)"
simple("c4_data_quality", lambda b: C.data_quality(_twice(b)), QUALITY + " SELECT {cols} FROM x", "!rows completeness duplicate_rate", ("symbol",))
Z = f""", p AS (SELECT *, {sdiv(D1, slag('close'))} AS price_change FROM b), s AS (SELECT symbol, avg(price_change) AS mp, stddev_samp(price_change) AS sp, avg(volume) AS mv, stddev_samp(volume) AS sv FROM p GROUP BY symbol),
z AS (SELECT p.*, CASE WHEN sp > 0 THEN (price_change - mp) / sp ELSE 0 END AS price_change_zscore, CASE WHEN sv > 0 THEN (volume - mv) / sv ELSE 0 END AS volume_zscore FROM p JOIN s USING (symbol)),
y AS (SELECT *, coalesce(abs(price_change_zscore) > 3, false) AS price_change_anomaly, coalesce(abs(volume_zscore) > 3, false) AS volume_anomaly FROM z)"""
simple("c5_anomalies", C.anomalies, Z + " SELECT {cols} FROM y", "price_change_zscore volume_zscore !price_change_anomaly !volume_anomaly")


def outliers_sql(kind: str) -> str:
    out, last = "", "b"
    for i, c in enumerate(OHLCV.split()):
        if kind == "iqr":
            out += f", q{i} AS (SELECT symbol, quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS z FROM {last} GROUP BY symbol), r{i} AS (SELECT x.* FROM {last} x JOIN q{i} USING (symbol) WHERE {c} >= a - 1.5 * (z - a) AND {c} <= z + 1.5 * (z - a))"
        else:
            out += f", q{i} AS (SELECT symbol, avg({c}) AS a, stddev_samp({c}) AS z FROM {last} GROUP BY symbol), r{i} AS (SELECT x.* FROM {last} x JOIN q{i} USING (symbol) WHERE NOT coalesce(z > 0, false) OR abs({c} - a) / z < 2.5)"
        last = f"r{i}"
    return out + f" SELECT {{cols}} FROM {last}".replace("{{", "{").replace("}}", "}")


simple("c6_outliers_iqr", lambda b: C.remove_outliers(b, "iqr", 1.5), outliers_sql("iqr"), OHLCV)
simple("c7_outliers_zscore", lambda b: C.remove_outliers(b, "zscore", 2.5), outliers_sql("zscore"), OHLCV)
add("c8_data_range", lambda s, sf: C.covers_range(hourly(s, sf), "2024-01-01 00:00:00", "2024-01-30 23:00:00").drop("exchange", "interval"), H + " SELECT symbol, min(timestamp) >= '2024-01-01' AND max(timestamp) <= '2024-01-30 23:00:00' AS in_range FROM b GROUP BY symbol")
simple("c9_quality_report", C.quality_report, REPORT + " SELECT {cols} FROM q", "!rows completeness !gaps !status", ("symbol",))
simple("c9_report_summary", lambda b: C.report_summary(C.quality_report(b)), REPORT + ", y AS (SELECT count(*) AS n_series, avg(completeness) AS mean_completeness, sum(gaps)::BIGINT AS total_gaps FROM q) SELECT {cols} FROM y", "mean_completeness !total_gaps", ("n_series",))


def grade(x: str, best: str, fair: str) -> str:
    return f"CASE WHEN {x} {best} THEN 'excellent' WHEN {x} {fair} THEN 'good' ELSE 'poor' END"


simple(
    "c10_rating",
    C.rating,
    Z + f", a AS (SELECT symbol, count(*) AS rows, (count(*) FILTER (WHERE price_change_anomaly) + count(*) FILTER (WHERE volume_anomaly)) / count(*)::DOUBLE AS anomaly_rate, least(1.0::DOUBLE, count(*) / {STEPS}) AS completeness, 0.0::DOUBLE AS duplicate_rate FROM y GROUP BY symbol), w AS (SELECT *, {grade('completeness', '>= 0.99', '>= 0.95')} AS completeness_grade, {grade('duplicate_rate', '< 0.01', '< 0.05')} AS duplicate_grade, {grade('anomaly_rate', '< 0.01', '< 0.05')} AS anomaly_grade FROM a) SELECT @ FROM w".replace("@", "{cols}"),
    "!rows completeness duplicate_rate anomaly_rate !completeness_grade !duplicate_grade !anomaly_grade",
    ("symbol",),
)
simple("c11_repair_plan", C.repair_plan, REPORT + GAPS.replace("x AS", "gg AS").replace("FROM x", "FROM gg") + " AND symbol IN (SELECT symbol FROM q WHERE completeness < 0.99)", "gap_seconds", ("symbol", "gap_start", "gap_end"))


def _reconciled(spark: SparkSession, sf: str) -> DataFrame:
    b = hourly(spark, sf)
    cat = b.where("symbol <> 'error'").groupBy(*SERIES).agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
    cat = cat.withColumn("end_time", F.when(F.col("symbol") == "click", F.col("end_time") - F.expr("INTERVAL 5 HOURS")).otherwise(F.col("end_time")))
    return C.reconcile(b, cat).select("symbol", "actual_start", "actual_end", "status")


add("c12_reconcile", _reconciled, H + " SELECT symbol, min(timestamp) AS actual_start, max(timestamp) AS actual_end, CASE WHEN symbol = 'click' THEN 'mismatch' ELSE 'missing_catalog' END AS status FROM b WHERE symbol IN ('click', 'error') GROUP BY symbol")
VIOL = {"negative_price": "least(open, high, low, close) < 0", "zero_price": "open = 0 OR high = 0 OR low = 0 OR close = 0", "high_below_low": "high < low", "high_below_open_close": "high < greatest(open, close)", "low_above_open_close": "low > least(open, close)"}
add(
    "c13_price_violations",
    lambda s, sf: C.price_violations(_dirty(s, sf).withColumn("open", F.col("open").try_cast("double"))).select("symbol", F.array_join("violations", ",").alias("violations"), "valid"),
    DIRTY + f", x AS (SELECT symbol, concat_ws(',', {', '.join(f'CASE WHEN bool_or({r}) THEN {k!r} END' for k, r in VIOL.items())}) AS violations FROM raw GROUP BY symbol) SELECT symbol, violations, violations = '' AS valid FROM x",
)
add("c14_high_low", lambda s, sf: C.high_low_report(_dirty(s, sf)).drop("exchange", "interval"), DIRTY + " SELECT symbol, count(*) FILTER (WHERE high < low) AS high_below_low, count(*) FILTER (WHERE close > high OR close < low) AS close_outside, count(*) FILTER (WHERE volume < 0) AS negative_volume FROM raw GROUP BY symbol")
add(
    "c15_valid_rows",
    lambda s, sf: (lambda d: d.groupBy("symbol", C.valid_bar().alias("valid")).agg(F.count(F.lit(1)).alias("n")))(_dirty(s, sf).withColumn("open", F.col("open").try_cast("double"))),
    DIRTY + " SELECT symbol, coalesce(high >= low AND high >= open AND high >= close AND low <= open AND low <= close, false) AND coalesce(volume, 0) >= 0 AS valid, count(*) AS n FROM raw GROUP BY ALL",
)
simple("c16_thresholds", lambda b: C.thresholds(_twice(b)), QUALITY + ", y AS (SELECT *, completeness >= 0.95 AS complete_ok, duplicate_rate <= 0.01 AS duplicates_ok FROM x) SELECT {cols} FROM y", "!rows completeness duplicate_rate !complete_ok !duplicates_ok", ("symbol",))

# --------------------------------------------------------------- coverage

RK = ["symbol", "start", "end"]


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    """One range for each user, event type and hour, as if loaded in pieces."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ms", epoch_ms("ts"))
    g = e.groupBy("event_type", "user_id", F.date_trunc("hour", "ts")).agg(F.min("ms").alias("start"), F.max("ms").alias("end"))
    return g.select(F.lit("events").alias("exchange"), F.col("event_type").alias("symbol"), F.lit("1m").alias("interval"), "start", "end")


RANGES = """WITH r AS (SELECT event_type AS symbol, min(epoch_us(ts) // 1000) AS start, max(epoch_us(ts) // 1000) AS "end" FROM events GROUP BY event_type, user_id, date_trunc('hour', ts))"""


def merged_sql(step: int, source: str = "r", name: str = "mg") -> str:
    return f""", {name}_h AS (SELECT *, max("end") OVER (PARTITION BY symbol ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM {source}),
{name}_i AS (SELECT *, sum(CASE WHEN held IS NULL OR start > held + {step} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM {name}_h),
{name} AS (SELECT symbol, min(start) AS start, max("end") AS "end" FROM {name}_i GROUP BY symbol, island)"""


FULL = """, cp AS (SELECT symbol, least(1.0::DOUBLE, sum("end" - start + 60000) / (max("end") - min(start) + 60000)::DOUBLE) AS completeness FROM mg GROUP BY symbol)"""
add("r1_merge_ranges", lambda s, sf: R.merge(_ranges(s, sf)).select(*RK), RANGES + merged_sql(60000) + ' SELECT symbol, start, "end" FROM mg')
add("r2_add_range", lambda s, sf: shown(R.completeness(R.add(_ranges(s, sf).where("start % 2 = 0"), _ranges(s, sf).where("start % 2 = 1"))), "completeness", ("symbol",)), RANGES + merged_sql(60000) + FULL + " SELECT symbol, round(completeness, 6) + 0.0 AS completeness FROM cp")
FIRST, LAST = 1704067200000, 1706659200000
SPANS = ((FIRST + 3 * 86400000, FIRST + 5 * 86400000), (FIRST - 3600000, FIRST + 86400000), (LAST - 86400000, LAST + 3600000))


def _requests(b: DataFrame) -> DataFrame:
    asked = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z in SPANS])
    return b.select(*SERIES).distinct().withColumn("_r", F.explode(asked)).select(*SERIES, F.col("_r.a").alias("request_start"), F.col("_r.z").alias("request_end"))


REQ = ", rq AS (SELECT symbol, unnest([" + ", ".join(f"{{'a': {a}::BIGINT, 'z': {z}::BIGINT}}" for a, z in SPANS) + "], recursive := true) FROM (SELECT DISTINCT symbol FROM r))"
MISSING = REQ + merged_sql(1) + """, nr AS (SELECT rq.symbol, a, z, CASE WHEN "end" >= a AND start <= z THEN start END AS s, CASE WHEN "end" >= a AND start <= z THEN "end" END AS e FROM rq LEFT JOIN mg ON rq.symbol = mg.symbol),
ms AS (SELECT symbol, a, z, coalesce(lag(e) OVER (PARTITION BY symbol, a, z ORDER BY s NULLS LAST) + 1, a) AS missing_start, s - 1 AS missing_end FROM nr WHERE s IS NOT NULL
  UNION ALL SELECT symbol, a, z, coalesce(max(e) + 1, a), z FROM nr GROUP BY symbol, a, z),
mi AS (SELECT symbol, a AS request_start, z AS request_end, missing_start, missing_end FROM ms WHERE missing_start <= missing_end)"""


def _missing(spark: SparkSession, sf: str) -> DataFrame:
    held = _ranges(spark, sf)
    return R.missing(held, _requests(held))


add("r3_missing_ranges", lambda s, sf: _missing(s, sf).drop("exchange", "interval"), RANGES + MISSING + " SELECT * FROM mi")
CUT_A, CUT_Z = FIRST + 10 * 86400000, FIRST + 12 * 86400000
add(
    "r4_delete_range",
    lambda s, sf: R.cut(R.merge(_ranges(s, sf)), CUT_A, CUT_Z).select(*RK),
    RANGES + merged_sql(60000) + f""", k AS (SELECT symbol, start, "end" FROM mg WHERE "end" < {CUT_A} OR start > {CUT_Z} UNION ALL SELECT symbol, start, least("end", {CUT_A - 1}) FROM mg WHERE NOT ("end" < {CUT_A} OR start > {CUT_Z})
  UNION ALL SELECT symbol, greatest(start, {CUT_Z + 1}), "end" FROM mg WHERE NOT ("end" < {CUT_A} OR start > {CUT_Z})) SELECT symbol, start, "end" FROM k WHERE start <= "end" """,
)
add("r5_extent", lambda s, sf: R.extent(_ranges(s, sf)).select(*RK), RANGES + ' SELECT symbol, min(start) AS start, max("end") AS "end" FROM r GROUP BY symbol')


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    old = storage.partition_records(daily(spark, sf)).select(*storage.KEYS, "records", F.lit(1).alias("updated_at"))
    new = old.where("month = 3").withColumn("records", F.col("records") + 100).withColumn("updated_at", F.lit(2))
    return R.upsert_partitions(old, new).select("symbol", "year", "month", "records", "updated_at")


add("r6_add_partition", _catalog, D + ", p AS (SELECT symbol, year(timestamp)::INT AS year, month(timestamp)::INT AS month, count(*) AS n FROM b GROUP BY ALL) SELECT symbol, year, month, CASE WHEN month = 3 THEN n + 100 ELSE n END AS records, CASE WHEN month = 3 THEN 2 ELSE 1 END::INT AS updated_at FROM p")
add("r7_coverage", lambda s, sf: R.covered(hourly(s, sf)).select(*RK, "rows"), H + ISLANDS + ' SELECT symbol, start, "end", rows FROM c')


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    held = _ranges(spark, sf)
    return R.explain_source(R.decide_source(held, _requests(held), least=0.3))


DECIDE = REQ + merged_sql(60000) + FULL + """, sp AS (SELECT symbol, min(start) AS s, max("end") AS e FROM r GROUP BY symbol), de AS (SELECT rq.symbol, a AS request_start, z AS request_end,
  CASE WHEN s IS NULL THEN 'no_data' WHEN s > a THEN 'starts_late' WHEN e < z THEN 'ends_early' WHEN completeness < 0.3 THEN 'incomplete' ELSE 'covered' END AS reason FROM rq LEFT JOIN sp USING (symbol) LEFT JOIN cp USING (symbol)),
dd AS (SELECT *, CASE WHEN reason = 'covered' THEN 'local' ELSE 'fetch' END AS source FROM de)"""
add("r8_decide_source", lambda s, sf: _decided(s, sf).select("symbol", "request_start", "request_end", "source", "reason"), RANGES + DECIDE + " SELECT symbol, request_start, request_end, source, reason FROM dd")
add("r9_explain", lambda s, sf: _decided(s, sf).select("symbol", "request_start", "explanation"), RANGES + DECIDE + " SELECT symbol, request_start, symbol || ' 1m: ' || source || ' (' || reason || ')' AS explanation FROM dd")


def _catalog_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog written, one symbol deleted, the months of another replaced, and read; records without an interval count as 1s."""
    p = storage.partition_records(daily(spark, sf)).withColumn("interval", F.when(F.col("month") != 1, F.col("interval")))
    path = scratch_path(spark, "catalog")
    catalog.write(p, path)
    catalog.delete(spark, path, "orders", "2-HIGH")
    catalog.upsert(spark, path, catalog.read(spark, path, symbol="3-MEDIUM", interval="1d").withColumn("records", F.col("records") + 1))
    return catalog.listing(spark, path).drop("exchange")


add(
    "r10_catalog",
    _catalog_trip,
    D + """, p AS (SELECT symbol, CASE WHEN month(timestamp) = 1 THEN '1s' ELSE '1d' END AS interval, year(timestamp) AS y, month(timestamp) AS m, count(*) AS k, min(timestamp) AS a, max(timestamp) AS z FROM b WHERE symbol <> '2-HIGH' GROUP BY ALL)
SELECT symbol, interval, count(*) AS months, sum(k + CASE WHEN symbol = '3-MEDIUM' AND interval = '1d' THEN 1 ELSE 0 END)::BIGINT AS records, min(a) AS start_time, max(z) AS end_time FROM p GROUP BY ALL""",
)
add("r11_metadata", lambda s, sf: R.nested(R.merge(_ranges(s, sf))).select("exchange", "symbol", F.size(F.col("intervals")["1m"]).cast("long").alias("n_ranges"), F.element_at(F.col("intervals")["1m"], 1)["start"].alias("first_start")), RANGES + merged_sql(60000) + " SELECT 'events' AS exchange, symbol, count(*) AS n_ranges, min(start) AS first_start FROM mg GROUP BY symbol")

# ----------------------------------------------------------------- ingest


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Exchange rows as JSON text, made from the hourly bars."""
    b = hourly(spark, sf)
    return b.select(*SERIES, F.to_json(F.array(epoch_ms("timestamp").cast("double"), *OHLCV.split())).alias("raw"))


END = "2024-01-20 00:00:00"
END_MS = 1705708800000
add("i1_parse_rows", lambda s, sf: shown(ingest.parse_rows(_raw(s, sf), end_ms=END_MS), OHLCV), H + f" SELECT {shown_sql(OHLCV)} FROM b WHERE timestamp <= '{END}'")


def _loaded(spark: SparkSession, sf: str) -> DataFrame:
    records = ingest.load(spark, ingest.parse_rows(_raw(spark, sf)), scratch_path(spark, "bars"), scratch_path(spark, "scratch"))
    return records.select("symbol", "year", "month", "records", "start_time", "end_time")


add("i2_load", _loaded, H + " SELECT symbol, year(timestamp)::INT AS year, month(timestamp)::INT AS month, count(*) AS records, min(timestamp) AS start_time, max(timestamp) AS end_time FROM b GROUP BY ALL")


def _overlap(spark: SparkSession, sf: str) -> DataFrame:
    b = hourly(spark, sf)
    held = R.covered(b.where("timestamp < timestamp_ntz'2024-01-10 00:00:00'"))
    asked = b.select(*SERIES).distinct().withColumns({"request_start": F.lit(FIRST), "request_end": F.lit(END_MS)})
    return shown(ingest.only_missing(b, R.missing(held, asked)), "close")


add("i3_load_missing", _overlap, H + f" SELECT {shown_sql('close')} FROM b WHERE timestamp >= '2024-01-10' AND timestamp <= '{END}'")


def _reloaded(spark: SparkSession, sf: str) -> DataFrame:
    root = stored(spark, sf, False)
    new = hourly(spark, sf).where("symbol = 'click'").withColumn("volume", F.lit(7.0))
    ingest.reload(spark, Q.in_range(new, "2024-01-10 00:00:00", "2024-01-11 00:00:00"), root, "2024-01-10 00:00:00", "2024-01-11 00:00:00", scratch_path(spark, "scratch"))
    return shown(storage.read_bars(spark, root), "volume")


add("i4_reload", _reloaded, H + " SELECT symbol, timestamp, CASE WHEN timestamp BETWEEN '2024-01-10' AND '2024-01-11' THEN 7.0::DOUBLE ELSE round(volume, 6) + 0.0 END AS volume FROM b WHERE symbol = 'click' OR timestamp NOT BETWEEN '2024-01-10' AND '2024-01-11'")
add("i5_update", lambda s, sf: shown(ingest.newer(hourly(s, sf), hourly(s, sf).where(f"timestamp < timestamp_ntz'{END}'"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")), "close"), H + f" SELECT {shown_sql('close')} FROM b WHERE timestamp >= '{END}'")
add("i6_expected", lambda s, sf: shown(ingest.expected_records(_requests(_ranges(s, sf)), _ranges(s, sf)), "!expected progress", ("symbol", "request_start", "request_end")), RANGES + MISSING + " SELECT rq.symbol, a AS request_start, z AS request_end, ((z - a) // 60000)::BIGINT AS expected, round(1.0::DOUBLE - coalesce(sum(missing_end - missing_start + 1), 0)::DOUBLE / (z - a + 1), 6) + 0.0 AS progress FROM rq LEFT JOIN mi ON rq.symbol = mi.symbol AND a = request_start AND z = request_end GROUP BY rq.symbol, a, z")
add("i7_earliest", lambda s, sf: ingest.earliest(hourly(s, sf)).select("symbol", "earliest"), H + " SELECT symbol, min(timestamp) AS earliest FROM b GROUP BY symbol")

# ------------------------------------------------------------------ feeds

RN = f", x AS (SELECT *, row_number() {OVER} AS rn FROM b)"
simple("f1_chunks", lambda b: Q.chunks(b, 50), RN + ", y AS (SELECT *, ((rn - 1) // 50)::BIGINT AS chunk_id FROM x) SELECT {cols} FROM y", "close !chunk_id")


add("f2_iterate", lambda s, sf: Q.delivered(hourly(s, sf)).select("symbol", "timestamp", "position"), H + " SELECT symbol, timestamp, row_number() OVER (ORDER BY symbol, timestamp) - 1 AS position FROM b")
simple("f3_to_dataframe", lambda b: Q.oldest(b, 100), RN + " SELECT {cols} FROM x WHERE rn <= 100", OHLCV)
add("f4_feed_stats", lambda s, sf: Q.chunk_statistics(hourly(s, sf), 50).drop("exchange", "interval"), H + " SELECT symbol, ceil(count(*) / 50)::BIGINT AS n_chunks, count(*) AS n_rows FROM b GROUP BY symbol")
simple(
    "f5_running_totals",
    lambda b: Q.chunk_totals(b, 50),
    RN + ", y AS (SELECT symbol, ((rn - 1) // 50)::BIGINT AS chunk_id, count(*) AS n, sum(volume) AS v, max(high) AS h, min(low) AS l FROM x GROUP BY ALL), z AS (SELECT symbol, chunk_id, (sum(n) OVER w)::BIGINT AS rows, sum(v) OVER w AS volume, max(h) OVER w AS high, min(l) OVER w AS low FROM y WINDOW w AS (PARTITION BY symbol ORDER BY chunk_id ROWS UNBOUNDED PRECEDING)) SELECT {cols} FROM z",
    "!rows volume high low",
    ("symbol", "chunk_id"),
)


def _ticks(spark: SparkSession, sf: str) -> DataFrame:
    # A pattern, since a file stream over a plain path wants a folder.
    return stream.tick_stream(spark, f"{sf}/events.parque[t]", "event_type", "value", exchange="events", tie="event_id")


def _stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    root, work = scratch_path(spark, "bars"), scratch_path(spark, "work")
    stream.ingest_stream(_ticks(spark, sf), root, f"{work}/rows", f"{work}/checkpoint")
    return shown(storage.read_bars(spark, root), OHLCV)


SECOND_BARS = H.replace("date_trunc('hour', ts)", "date_trunc('second', ts)").replace("'1h'", "'1s'")
add("f6_stream_ingest", _stream_ingest, SECOND_BARS + f" SELECT {shown_sql(OHLCV)} FROM b WHERE timestamp + INTERVAL 1 SECOND <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)")


def _stream_bars(spark: SparkSession, sf: str) -> DataFrame:
    work = scratch_path(spark, "work")
    return shown(stream.run_to_files(stream.bar_stream(_ticks(spark, sf), "1h"), f"{work}/bars", f"{work}/checkpoint"), OHLCV)


add("f7_stream_bars", _stream_bars, H + f" SELECT {shown_sql(OHLCV)} FROM b WHERE timestamp + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)")


#: Seconds of events that wait together; they are sparse.
STRETCH = 43_200


def _stream_ema(spark: SparkSession, sf: str) -> DataFrame:
    work = scratch_path(spark, "work")
    out = stream.run_to_files(stream.ema_stream(_ticks(spark, sf), 12, grain=STRETCH), f"{work}/ema", f"{work}/checkpoint")
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("timestamp"), (F.round("ema", 6) + 0.0).alias("ema"))


add("f8_stream_ema", _stream_ema, f"WITH b AS (SELECT event_type AS symbol, ts AS timestamp, value FROM events) SELECT symbol, timestamp, round({sema('value', 12)}, 6) + 0.0 AS ema FROM b")



def _stream_rsi(spark: SparkSession, sf: str) -> DataFrame:
    work = scratch_path(spark, "work")
    out = stream.run_to_files(stream.rsi_stream(_ticks(spark, sf), 14, grain=STRETCH), f"{work}/rsi", f"{work}/checkpoint")
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("timestamp"), (F.round("rsi", 6) + 0.0).alias("rsi_14"))


add("f8_stream_rsi", _stream_rsi, layers(*RSI, base="WITH b AS (SELECT event_type AS symbol, ts AS timestamp, value AS close FROM events)").format(shown_sql("rsi_14")))


#: Files, one micro-batch each, in which ticks of the shuffled stream come, and how far behind the newest one a tick may be.
SHUFFLED_FILES, SHUFFLED_LATE = 5, "3 hours"
#: Bytes of a row group of these files.
SHUFFLED_GROUP = 4 << 20


def _shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """The ticks in files that overlap in time by up to two hours and are out of order inside."""
    # Only columns that the stream reads, in row groups small enough that several tasks read a file.
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type", "value").withColumn("_at", epoch_ms("ts") + F.pmod(F.xxhash64("event_id"), F.lit(7_200_000)))
    low, high = e.agg(F.min("_at"), F.max("_at")).first()
    path = scratch_path(spark, "shuffled")
    for k in range(SHUFFLED_FILES):  # in order of writing, which is the order in which the stream takes them
        part = e.where(F.least(F.floor((F.col("_at") - low) * SHUFFLED_FILES / (high - low + 1)), F.lit(SHUFFLED_FILES - 1)) == k)
        part.drop("_at").repartition(1, "event_id").sortWithinPartitions(F.xxhash64("event_id", F.lit(1))).write.option("parquet.block.size", SHUFFLED_GROUP).mode("append").parquet(path)
    return stream.tick_stream(spark, path, "event_type", "value", exchange="events", files=1, tie="event_id")


def _shuffled_means(spark: SparkSession, sf: str) -> DataFrame:
    work = scratch_path(spark, "work")
    out = stream.run_to_files(stream.ema_stream(_shuffled(spark, sf), 12, SHUFFLED_LATE, STRETCH), f"{work}/ema", f"{work}/checkpoint")
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("timestamp"), (F.round("ema", 6) + 0.0).alias("ema"))


def _shuffled_strength(spark: SparkSession, sf: str) -> DataFrame:
    work = scratch_path(spark, "work")
    out = stream.run_to_files(stream.rsi_stream(_shuffled(spark, sf), 14, SHUFFLED_LATE, STRETCH), f"{work}/rsi", f"{work}/checkpoint")
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("timestamp"), (F.round("rsi", 6) + 0.0).alias("rsi_14"))


TICKS = "WITH b AS (SELECT event_type AS symbol, ts AS timestamp, value AS close FROM events)"
CLOSED = " WHERE date_trunc('milliseconds', timestamp) <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 3 HOURS FROM events)"
add("f8_stream_ema_shuffled", _shuffled_means, f"SELECT * FROM ({TICKS} SELECT symbol, timestamp, round({sema('close', 12)}, 6) + 0.0 AS ema FROM b)" + CLOSED)
add("f8_stream_rsi_shuffled", _shuffled_strength, "SELECT * FROM (" + layers(*RSI, base=TICKS).format(shown_sql("rsi_14")) + ")" + CLOSED)

# ---------------------------------------------------------------- recipes


def _ma_cross(b: DataFrame) -> DataFrame:
    b = I.rsi(I.moving_averages(b, (20, 50)))
    raw = F.when(F.col("sma_20") > F.col("sma_50"), 1).when(F.col("sma_20") < F.col("sma_50"), -1).otherwise(0)
    b = b.withColumn("_s", raw)
    return b.withColumn("signal", F.when((F.col("_s") == 1) & (F.col("rsi_14") > 70), 0).when((F.col("_s") == -1) & (F.col("rsi_14") < 30), 0).otherwise(F.col("_s")))


SMAS = {f"sma_{n}": sroll("avg", "close", n) for n in (20, 50, 200)}
on_bars("x1_ma_cross", _ma_cross, [*RSI, SMAS, {"s0": "CASE WHEN sma_20 > sma_50 THEN 1 WHEN sma_20 < sma_50 THEN -1 ELSE 0 END"}, {"signal": "(CASE WHEN s0 = 1 AND rsi_14 > 70 THEN 0 WHEN s0 = -1 AND rsi_14 < 30 THEN 0 ELSE s0 END)::INT"}], "!signal")


def _spread(spark: SparkSession, sf: str) -> DataFrame:
    """Last price of each symbol (priority) on each exchange (status), against the cheapest and dearest."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    last = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderstatus").alias("exchange")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("price"))
    limits = last.groupBy("symbol").agg(F.min("price").alias("_lo"), F.max("price").alias("_hi"))
    df = last.join(limits, "symbol")
    df = df.withColumns({"over_min_pct": 100 * div(F.col("price") - F.col("_lo"), "_lo"), "under_max_pct": 100 * div(F.col("_hi") - F.col("price"), "_hi"), "spread_pct": 100 * div(F.col("_hi") - F.col("_lo"), "_lo")})
    return shown(df, "price over_min_pct under_max_pct spread_pct", ("symbol", "exchange"))


add(
    "x2_spread",
    _spread,
    f"WITH l AS (SELECT o_orderpriority AS symbol, o_orderstatus AS exchange, arg_max(o_totalprice, {{'d': o_orderdate, 'k': o_orderkey}}) AS price FROM orders GROUP BY ALL), m AS (SELECT *, min(price) OVER (PARTITION BY symbol) AS lo, max(price) OVER (PARTITION BY symbol) AS hi FROM l), y AS (SELECT *, 100 * (price - lo) / lo AS over_min_pct, 100 * (hi - price) / hi AS under_max_pct, 100 * (hi - lo) / lo AS spread_pct FROM m) SELECT {shown_sql('price over_min_pct under_max_pct spread_pct', ('symbol', 'exchange'))} FROM y",
)


def _own(b: DataFrame) -> DataFrame:
    b = b.withColumns({"momentum_5": 100 * div(F.col("close") - prev("close", 5), prev("close", 5)), "volatility_20": roll(F.stddev_samp, "close", 20), "volume_change": 100 * div(F.col("volume") - prev("volume"), prev("volume")), "high_20": roll(F.max, "high", 20), "low_20": roll(F.min, "low", 20)})
    return b.withColumns({"range_position": div(F.col("close") - F.col("low_20"), F.col("high_20") - F.col("low_20")), "bull_power": F.col("high") - F.col("open"), "bear_power": F.col("open") - F.col("low")})


on_bars(
    "x3_custom_columns",
    _own,
    [
        {"momentum_5": f"100 * {sdiv(f'close - {slag("close", 5)}', slag('close', 5))}", "volatility_20": sroll("stddev_samp", "close", 20), "volume_change": f"100 * {sdiv(f'volume - {slag("volume")}', slag('volume'))}", "high_20": sroll("max", "high", 20), "low_20": sroll("min", "low", 20)},
        {"range_position": sdiv("close - low_20", "high_20 - low_20"), "bull_power": "high - open", "bear_power": "open - low"},
    ],
    "momentum_5 volatility_20 volume_change high_20 low_20 range_position bull_power bear_power",
    digits=5,
)
on_bars("x4_trend_alignment", lambda b: I.moving_averages(b, (20, 50, 200)).withColumn("trend", F.when((F.col("sma_20") > F.col("sma_50")) & (F.col("sma_50") > F.col("sma_200")), "up").when((F.col("sma_20") < F.col("sma_50")) & (F.col("sma_50") < F.col("sma_200")), "down").otherwise("none")), [SMAS, {"trend": "CASE WHEN sma_20 > sma_50 AND sma_50 > sma_200 THEN 'up' WHEN sma_20 < sma_50 AND sma_50 < sma_200 THEN 'down' ELSE 'none' END"}], "!trend")


def _regime(b: DataFrame) -> DataFrame:
    b = I.bollinger(I.atrp(b))
    return b.withColumn("high_volatility", F.coalesce(F.col("atrp_14") > 3, F.lit(False))).withColumn("squeeze", F.coalesce(F.col("boll_width") < 0.5 * roll(F.avg, "boll_width", 50), F.lit(False)))


on_bars("x5_volatility_regime", _regime, [*ATR, {"atrp_14": f"100 * {sdiv('atr_14', 'close')}", "m": sroll("avg", "close", 20), "sd": sroll("stddev_samp", "close", 20)}, {"width": "(m + 2 * sd) - (m - 2 * sd)"}, {"high_volatility": "coalesce(atrp_14 > 3, false)", "squeeze": f"coalesce(width < 0.5 * {sroll('avg', 'width', 50)}, false)"}], "!high_volatility !squeeze")
on_bars(
    "x6_combined_signal",
    lambda b: I.rsi(I.macd(b)).withColumn("signal", F.when((F.col("macd") > F.col("macd_signal")) & (F.col("rsi_14") < 70), "buy").when((F.col("macd") < F.col("macd_signal")) & (F.col("rsi_14") > 30), "sell").otherwise("hold")),
    [*RSI, *MACD, {"signal": "CASE WHEN macd > macd_signal AND rsi_14 < 70 THEN 'buy' WHEN macd < macd_signal AND rsi_14 > 30 THEN 'sell' ELSE 'hold' END"}],
    "!signal",
)


def _day(b: DataFrame) -> DataFrame:
    end = F.lit(NOW).cast("timestamp_ntz")
    d = b.where((F.col("timestamp") <= end) & (F.col("timestamp") > end - F.expr("INTERVAL 24 HOURS")))
    return d.groupBy("symbol").agg(F.max_by("close", "timestamp").alias("last_close"), (F.try_divide(F.max_by("close", "timestamp"), F.min_by("open", "timestamp")) - 1).alias("change"), F.sum("volume").alias("volume"))


simple("x7_day_monitor", _day, f", y AS (SELECT symbol, arg_max(close, timestamp) AS last_close, arg_max(close, timestamp) / arg_min(open, timestamp) - 1 AS change, sum(volume) AS volume FROM b WHERE timestamp <= '{NOW}' AND timestamp > TIMESTAMP '{NOW}' - INTERVAL 24 HOURS GROUP BY symbol) SELECT @ FROM y".replace("@", "{cols}"), "last_close change volume", ("symbol",))


def _events(b: DataFrame) -> DataFrame:
    b = I.moving_averages(b, (10, 20))
    b = I.crossunder(I.crossover(b, "sma_10", "sma_20", "_up"), "sma_10", "sma_20", "_down")
    return b.withColumn("action", F.when(F.col("_up"), "BUY").when(F.col("_down"), "SELL")).where("action is not null")


on_bars("x8_cross_events", _events, [{"a": sroll("avg", "close", 10), "z": sroll("avg", "close", 20)}, {"o": "coalesce(a > z, false)", "u": "coalesce(a < z, false)"}, {"action": f"CASE WHEN o AND NOT coalesce({slag('o')}, false) THEN 'BUY' WHEN u AND NOT coalesce({slag('u')}, false) THEN 'SELL' END"}], "!action close", tail="WHERE action IS NOT NULL")


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars with a fault of another kind in each symbol but one, where its bars allow it."""
    b, at = hourly(spark, sf), F.hour("timestamp") == 3
    for symbol, name, value in (("click", "close", F.lit(None)), ("error", "volume", -F.col("volume")), ("signup", "high", F.col("low") - 1)):
        b = b.withColumn(name, F.when(at & (F.col("symbol") == symbol), value).otherwise(F.col(name)))
    return b.unionByName(b.where(at & (F.col("symbol") == "purchase")))


FAULTY = """, f AS (SELECT symbol, timestamp, open, CASE WHEN symbol = 'signup' AND hour(timestamp) = 3 THEN low - 1 ELSE high END AS high, low, CASE WHEN symbol = 'click' AND hour(timestamp) = 3 THEN NULL ELSE close END AS close, CASE WHEN symbol = 'error' AND hour(timestamp) = 3 THEN -volume ELSE volume END AS volume FROM b),
u AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE symbol = 'purchase' AND hour(timestamp) = 3)
SELECT symbol, bool_and(open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL) AS not_null, bool_and(coalesce(volume >= 0, false)) AS positive_volume,
  bool_and(coalesce(high >= low AND high >= open AND high >= close AND low <= open AND low <= close, false) AND coalesce(volume, 0) >= 0) AS valid_ohlc, count(*) = count(DISTINCT timestamp) AS chronological FROM u GROUP BY symbol"""
add("x9_dataset_checks", lambda s, sf: C.dataset_checks(_checked(s, sf)).drop("exchange", "interval"), H + FAULTY)
