"""Cleaning, coverage, storage and ingest on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barsmith import core
from barsmith.operators import client
from barsmith.operators import quality as C
from barsmith.operators import queries as Q
from barsmith.operators import ranges as R
from barsmith.plans import table_queries
from barsmith.plans.tables import QUERIES
from barsmith.sources import catalog, ingest, storage

KEYS = "exchange string, symbol string, interval string"
DAY = dt.datetime(2024, 3, 1)


def test_clean(spark):
    t = lambda m: int((DAY + dt.timedelta(minutes=m) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    rows = [
        (t(0), "10", "9.5", "9", "10", "1", 1), (t(1), "10", "11", "10.5", "10", "1", 2), (t(2), "10", "8", "9", "10", "1", 3), (t(3), "10", "11", "9", "10", "-1", 4),
        (t(4), "bad", "11", "9", "10", "1", 5), (t(5), "1", "1", "1", "1", "1", 6), (t(5), "2", "2", "2", "2", None, 7), (None, "1", "1", "1", "1", "1", 8),
    ]
    df = spark.createDataFrame([("x", "A", "1m", *r) for r in rows], f"{KEYS}, timestamp long, open string, high string, low string, close string, volume string, ingest_seq int")
    got = {r.timestamp.minute: r for r in C.clean(df).collect()}
    assert set(got) == {0, 1, 3, 5} and got[0].high == 10 and got[1].low == 10 and got[3].volume == 0 and got[5].close == 2 and got[5].volume is None
    assert C.clean_counts(df.withColumn("timestamp", core.from_ms("timestamp"))).first().dropped_high_low == 1


def ranges(spark, pairs, interval="1m"):
    return spark.createDataFrame([("x", "A", interval, a, b) for a, b in pairs], f"{KEYS}, start long, end long")


def pairs(df, a="start", b="end"):
    return sorted((r[a], r[b]) for r in df.collect())


def test_range_algebra(spark):
    held = ranges(spark, [(0, 10), (11, 20), (40, 50)])
    assert pairs(R.merge(held, 1)) == [(0, 20), (40, 50)] and R.completeness(held, 1).first().completeness == 32 / 51
    ask = lambda a, b: spark.createDataFrame([("x", "A", "1m", a, b), ("x", "B", "1m", a, b)], f"{KEYS}, request_start long, request_end long")
    gaps = R.missing(ranges(spark, [(10, 20), (30, 40)]), ask(5, 35))
    assert pairs(gaps.where("symbol = 'A'"), "missing_start", "missing_end") == [(5, 9), (21, 29)]
    assert pairs(gaps.where("symbol = 'B'"), "missing_start", "missing_end") == [(5, 35)]
    assert pairs(R.missing(ranges(spark, [(0, 9)]), ask(1, 4)).where("symbol = 'A'"), "missing_start", "missing_end") == []
    assert pairs(R.cut(ranges(spark, [(0, 100), (200, 300)]), 40, 60)) == [(0, 39), (61, 100), (200, 300)]
    assert pairs(R.cut(ranges(spark, [(45, 50)]), 40, 60)) == []
    decided = {r.symbol: (r.source, r.reason) for r in R.decide_source(ranges(spark, [(0, 120_000)]), ask(0, 120_000)).collect()}
    assert decided == {"A": ("local", "covered"), "B": ("fetch", "no_data")}


def test_missing_parts_against_a_walk(spark):
    import random

    rng = random.Random(5)
    held = [(a, a + rng.randint(0, 400)) for a in rng.sample(range(5000), 25)]
    asks = [(a, a + rng.randint(-1, 2500)) for a in rng.sample(range(-200, 5600), 20)]
    covered = {t for a, b in held for t in range(a, b + 1)}
    want = []
    for a, b in asks:
        part = None
        for t in range(a, b + 1):
            if t not in covered:
                part = [a, b, t, t] if part is None else [*part[:3], t]
            if part and (t in covered or t == b):
                want.append(tuple(part))
                part = None
    ask = spark.createDataFrame([("x", "A", "1m", a, b) for a, b in asks], f"{KEYS}, request_start long, request_end long")
    for size in (100, R.BIN):
        got = [(r.request_start, r.request_end, r.missing_start, r.missing_end) for r in R.missing(ranges(spark, held), ask, size).collect()]
        assert sorted(got) == sorted(want)


def test_bars_of_missing_parts(spark):
    b = month(spark, rows=20)
    at = lambda d: int((DAY + dt.timedelta(days=d) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    gaps = spark.createDataFrame([("x", "A", "1d", at(2), at(6)), ("x", "A", "1d", at(5), at(9) - 1), ("x", "B", "1d", at(0), at(20))], f"{KEYS}, missing_start long, missing_end long")
    assert sorted(r.volume for r in ingest.only_missing(b, gaps).collect()) == [2, 3, 4, 5, 6, 7, 8]


def test_client_and_feed(spark):
    b = month(spark).unionByName(month(spark, "B/C", rows=3))
    got = client.get(b, "2024-03-02 00:00:00", "2024-03-20 00:00:00", interval="daily", indicators=["SMA_2"], limit=4).collect()
    assert {r.symbol for r in got} == {"A"} and len(got) == 4 and all(r.SMA_2 == 5.0 for r in got)
    assert {(r.symbol, r.source) for r in client.sources(b, "2024-03-02 00:00:00", "2024-03-20 00:00:00").collect()} == {("A", "local"), ("B/C", "fetch")}
    assert client.latest(b, 2, symbol="A").count() == 2 and client.before(b, "2024-03-04 00:00:00", 2, indicators=["SMA_2"]).columns[-1] == "SMA_2"
    for bad in (lambda: client.latest(b, interval="7x"), lambda: client.latest(b, symbol="/C")):
        with pytest.raises(ValueError):
            bad()
    parts = list(Q.iterate(b, 10))
    assert [len(p) for p in parts] == [10, 10, 10, 10, 3] and [r["volume"] for r in Q.iterate_rows(b, 7)] == [*map(float, range(40)), 0.0, 1.0, 2.0]
    assert [r.position for r in Q.delivered(b.repartition(5)).orderBy("symbol", "timestamp").collect()] == list(range(43))


def test_catalog(spark, tmp_path):
    path = str(tmp_path / "catalog")
    catalog.write(storage.partition_records(month(spark).unionByName(month(spark, "B/C"))), path)
    catalog.upsert(spark, path, catalog.read(spark, path, symbol="A").where("month = 4").withColumn("records", F.lit(1).cast("long")))
    assert sorted((r.symbol, r.months, r.records) for r in catalog.listing(spark, path).collect()) == [("A", 2, 32), ("B/C", 2, 40)]
    catalog.delete(spark, path, "x", "A", "1h")
    catalog.delete(spark, path, "x", "B/C")
    assert [(r.symbol, r.months) for r in catalog.listing(spark, path).collect()] == [("A", 2)]


def test_outliers_in_one_scan_a_step(spark):
    df = month(spark).withColumn("close", F.when(F.col("volume") == 7, 99.0).otherwise(F.col("volume")))
    kept = C.remove_outliers(df, columns=("close", "volume"))
    assert kept.count() == 39 and kept.where("volume = 7").count() == 0 and C.remove_outliers(df, accuracy=1000).count() == 39
    assert kept._jdf.queryExecution().executedPlan().toString().count("Scan") <= 3


def month(spark, symbol="A", rows=40, close=5.0):
    data = [("x", symbol, "1d", DAY + dt.timedelta(days=i), close, close, close, close, float(i)) for i in range(rows)]
    return spark.createDataFrame(data, core.BAR_SCHEMA)


def test_storage_round_trip_and_pruning(spark, tmp_path):
    root = str(tmp_path / "bars")
    storage.write_bars(month(spark).unionByName(month(spark, "B/C")), root)
    df = storage.read_range(spark, root, "x", "B/C", "2024-03-20", "2024-04-03", "1d")
    assert [r.volume for r in df.collect()] == [float(i) for i in range(19, 34)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan.split("PartitionFilters")[1][:400]
    assert storage.read_range(spark, root, "x", "none", "2024-03-20", "2024-04-03", "1d").count() == 0
    records = storage.upsert(spark, root, month(spark, rows=3, close=9.0), str(tmp_path / "s1"))
    assert [(r.month, r.records) for r in records.collect()] == [(3, 31)]
    back = storage.read_bars(spark, root)
    assert back.count() == 80 and back.where("close = 9").count() == 3
    counts = storage.delete_range(spark, root, "2024-04-01", "2024-04-30", str(tmp_path / "s2"), "symbol = 'A'")
    assert [(r.month, r.deleted, r.remaining) for r in counts.collect()] == [(4, 9, 0)]
    assert storage.read_bars(spark, root).where("symbol = 'A'").count() == 31
    storage.delete_range(spark, root, "2024-04-01", "2024-04-30", str(tmp_path / "s5"), "symbol = 'B/C'")
    assert storage.read_bars(spark, root).count() == 62
    storage.compact(spark, root, str(tmp_path / "s3"))
    assert storage.read_bars(spark, root).count() == 62
    fresh = storage.upsert(spark, str(tmp_path / "new"), month(spark, rows=2), str(tmp_path / "s4"))
    assert fresh.first().records == 2


def test_summary_row(spark):
    first = ("x", "A", "1m", DAY, 5.0, 5.0, 5.0, 5.0, 1000.0)
    rows = [first] + [("x", "A", "1m", DAY + dt.timedelta(minutes=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(1, 8)]
    assert storage.without_summary_rows(spark.createDataFrame(rows, core.BAR_SCHEMA)).count() == 7
    assert storage.without_summary_rows(spark.createDataFrame(rows[:5], core.BAR_SCHEMA)).count() == 5


def test_raw_rows(spark):
    df = spark.createDataFrame([("x", "A", "1d", "[1502928000000, 4261.48, 4485.39, 4200.74, 4285.08, 795.15037]"), ("x", "B", "1d", "[[0, 1, 2, 0.5, 1.5, 9], [86400000, 1, 2, 0.5, 1.5, null]]")], f"{KEYS}, raw string")
    got = ingest.parse_rows(df)
    assert got.where("symbol = 'A'").first().timestamp == dt.datetime(2017, 8, 17) and got.count() == 3
    assert ingest.parse_rows(df, end_ms=0).count() == 1


def test_quality_measures(spark):
    df = month(spark, rows=10).where("volume not in (3, 4)")
    row = C.quality_report(df).first()
    assert row.rows == 8 and row.completeness == 0.8 and row.gaps == 1 and row.status == "repair"
    gap = C.gaps(df).first()
    assert (gap.gap_start.day, gap.gap_end.day, gap.gap_seconds) == (3, 6, 3 * 86400.0)
    twice = df.unionByName(df.limit(2))
    assert C.data_quality(twice).first().duplicate_rate == 0.2
    assert C.price_violations(df.withColumn("high", F.lit(1.0))).first().violations == ["high_below_low", "high_below_open_close"]
    good, bad = C.split_valid(df.withColumn("high", F.when(F.col("volume") > 5, 1.0).otherwise(F.col("high"))))
    assert (good.count(), bad.count()) == (4, 4)


def test_running_means_go_on_from_their_state():
    import numpy as np

    from barsmith.streaming.bars import _means

    x = np.random.default_rng(2).normal(size=50)
    whole, first = _means(x, None, 0.2), _means(x[:20], None, 0.2)
    assert np.allclose(np.concatenate((first, _means(x[20:], float(first[-1]), 0.2))), whole)


def test_only_the_changed_month_differs_when_sums_come_in_any_order(spark, monkeypatch):
    import numpy as np

    def shuffled(frames):
        return (f.sample(frac=1, random_state=np.random.default_rng()) for f in frames)

    def daily(spark, sf):
        days = spark.range(6000).select(F.when(F.col("id") < 300, "1-URGENT").otherwise("2-HIGH").alias("symbol"), F.timestamp_add("MONTH", F.floor(F.col("id") / 300), F.lit("1997-05-05").cast("timestamp_ntz")).alias("ts"), F.rand(1).alias("price"), "id")
        return core.bars_from_ticks(days.coalesce(1).mapInPandas(shuffled, days.schema), "symbol", "price", "1d", tie="id")

    monkeypatch.setattr(table_queries, "daily", daily)
    assert [tuple(r) for r in QUERIES["s14_fingerprint"](spark, "").collect()] == [("1-URGENT", 1997, 5)]
