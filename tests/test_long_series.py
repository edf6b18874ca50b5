"""Series, gaps, coverage and catalogs that don't fit one task: two-level forms against whole ones and brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsmith import core
from barsmith.functions import registry
from barsmith.operators import indicators as I
from barsmith.operators import queries as Q
from barsmith.operators import ranges as R
from barsmith.sources import catalog

T0 = dt.datetime(2024, 1, 1)
BARS = "exchange string, symbol string, interval string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double"


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "37")
    yield
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def two(spark):
    """Two series of minutes with gaps, some values null."""
    rng = np.random.default_rng(4)
    rows = []
    for symbol, n in (("A", 700), ("B", 260), ("C", 3)):
        minute, close = 0, 100 + rng.normal(size=n).cumsum()
        for i in range(n):
            minute += int(rng.choice([1, 1, 1, 2, 90]))
            c = float(close[i])
            rows.append(("x", symbol, "1m", T0 + dt.timedelta(minutes=minute), c, c + 1 + float(rng.random()), c - 1, c, float(rng.integers(0, 9)), None if rng.random() < 0.2 or i < 2 or 150 <= i < 330 else c))
    return core.written(spark.createDataFrame(rows, f"{BARS}, v double"), "two")


def table(df, names):
    return {(r.symbol, r.timestamp): [r[n] for n in names] for r in df.collect()}


def equal(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k], strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-9)), (k, a[k], b[k])


@pytest.mark.parametrize("size, history", [(50, 30), (50, 0), (1, 0), (64, 64), (1000, 7)])
def test_sums_and_means_over_blocks(spark, small_batches, two, size, history):
    def f(df):
        df = I.ad(I.vwap(I.obv(df) if history else df))
        df = core.emas(df, {"e3": ("v", 3), "e900": ("v", 900)}, then={"of": (("e3", "e900"), lambda a, b: a - b, 9)})
        return core.emas(df, {"n3": ("v", 3), "n900": ("v", 900)}, adjust=True)

    names = ["vwap", "ad", "e3", "e900", "of", "n3", "n900"] + (["obv"] if history else [])
    equal(table(core.in_blocks(two, f, history, size), names), table(f(two), names))


def test_means_equal_pandas_over_batches(spark, small_batches, two):
    for adjust in (False, True):
        got = core.emas(two, {"y": ("v", 11)}, adjust).toPandas().sort_values(["symbol", "timestamp"])
        want = got.groupby("symbol")["v"].transform(lambda s: s.ewm(span=11, adjust=adjust).mean())
        np.testing.assert_allclose(got["y"], want, rtol=1e-10, equal_nan=True)


def test_values_that_are_not_finite_stay_in_their_series(spark, small_batches):
    rows = [("x", s, "1m", T0 + dt.timedelta(minutes=i), c, c, c, c, 1.0) for s, xs in (("A", [float("inf"), 1.0, float("nan"), 2.0]), ("B", [1.0, 2.0])) for i, c in enumerate(xs)]
    got = table(core.ema(spark.createDataFrame(rows, BARS).coalesce(1), "close", 3, "y"), ["y"])
    assert [got[("B", T0 + dt.timedelta(minutes=i))][0] for i in range(2)] == [1.0, 1.5]


def test_a_preset_takes_blocks_by_itself(spark, two):
    plain = registry.add_common(two, (5, 10))
    names = [c for c in plain.columns if c not in two.columns]
    parts = core.in_blocks(two, lambda b: registry.add_common(b, (5, 10)), 20, 128)
    equal(table(parts, names), table(plain, names))
    seen = []
    core.spread(two, lambda b: seen.append(core.is_blocked(b)) or b, 5, limit=699)
    core.spread(two, lambda b: seen.append(core.is_blocked(b)) or b, 5, limit=700)
    assert seen == [True, False]


def test_positions_are_row_numbers(spark, two):
    got = core.positions(two, "p", size=16).toPandas().sort_values(["symbol", "timestamp"])
    assert (got["p"] == got.groupby("symbol").cumcount()).all()
    with_null = two.withColumn("exchange", F.lit(None).cast("string"))
    assert core.positions(with_null, "p", size=16).count() == two.count()


def test_linear_weights_and_frames(spark, small_batches, two):
    def f(df):
        return I.rolling_stats(I.cci(I.hma(I.wma(df, 7, "v"), 9)), "v", 6, ("median", "mean"))

    got = f(two).toPandas().sort_values(["symbol", "timestamp"])
    w = lambda n: lambda s: s.rolling(n).apply(lambda x: np.dot(x, np.arange(1, n + 1)) / (n * (n + 1) / 2), raw=True)
    g = got.groupby("symbol")
    np.testing.assert_allclose(got["wma_7"], g["v"].transform(w(7)), rtol=1e-9, equal_nan=True)
    got["raw"] = 2 * g["close"].transform(w(4)) - g["close"].transform(w(9))
    np.testing.assert_allclose(got["hma_9"], got.groupby("symbol")["raw"].transform(w(3)), rtol=1e-9, equal_nan=True)
    np.testing.assert_allclose(got["v_rolling_median_6"], g["v"].transform(lambda s: s.rolling(6).median()), rtol=1e-12, equal_nan=True)
    tp = (got["high"] + got["low"] + got["close"]) / 3
    by = tp.groupby(got["symbol"])
    mad = by.transform(lambda s: s.rolling(20).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True))
    np.testing.assert_allclose(got["cci_20"], (tp - by.transform(lambda s: s.rolling(20).mean())) / (0.015 * mad), rtol=1e-9, equal_nan=True)


def test_gaps_are_filled_like_a_grid(spark, two):
    odd = two.unionByName(two.where("symbol = 'B'").limit(3)).unionByName(two.where("symbol = 'A'").limit(2).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 13 SECONDS")))
    got = Q.densify(odd, "1m", size=64).toPandas()
    rows = odd.toPandas()
    for symbol, part in rows.groupby("symbol"):
        first, last = part["timestamp"].min(), part["timestamp"].max()
        on = part[(part["timestamp"] - first) % pd.Timedelta("1min") == pd.Timedelta(0)]
        grid = pd.DataFrame({"timestamp": pd.date_range(first, last, freq="1min")}).merge(on, how="left", on="timestamp")
        mine = got[got["symbol"] == symbol]
        key = ["timestamp", "close"]
        pd.testing.assert_frame_equal(mine[key].sort_values(key).reset_index(drop=True), grid[key].sort_values(key).reset_index(drop=True), check_dtype=False)


def test_a_gap_of_millions_of_seconds(spark):
    rows = [("x", "A", "1s", T0, 1.0, 1.0, 1.0, 1.0, 1.0), ("x", "A", "1s", T0 + dt.timedelta(seconds=20_000_000), 2.0, 2.0, 2.0, 2.0, 1.0)]
    out = Q.densify(spark.createDataFrame(rows, BARS), "1s")
    r = out.select("close", F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count("close").alias("k"), F.count_distinct("t").alias("tasks")).first()
    assert (r.n, r.k) == (20_000_001, 2) and r.tasks > 4
    assert Q.densify(out.where("false"), "1s").count() == 0


def brute_merge(spans, step):
    out = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1] + step:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def spans(spark, rows):
    return spark.createDataFrame([("x", s, "1m", a, z) for s, a, z in rows], "exchange string, symbol string, interval string, start long, end long")


@pytest.mark.parametrize("bin_ms", [1, 7, 100, R.BIN])
def test_coverage_equals_brute_force(spark, bin_ms):
    rng = random.Random(bin_ms)
    rows = [(s, a, a + rng.choice([0, 1, 3, 9, 300])) for s in "AB" for a in rng.sample(range(-500, 1500), 60)] + [("A", 5, 1), ("B", 10, 10), ("B", 10, 10)]
    for step in (0, 1, 5):
        got = sorted((r.symbol, r.start, r.end) for r in R.merge(spans(spark, rows), step, bin_ms).collect())
        assert got == sorted((s, a, z) for s in "AB" for a, z in brute_merge([(a, z) for t, a, z in rows if t == s], step))
    rows = [r for r in rows if r[1] <= r[2]]
    asked = [(s, a, a + rng.choice([-1, 0, 5, 40, 900])) for s in "ABC" for a in rng.sample(range(-700, 1800), 12)] + [("A", -(1 << 62), 1 << 62), ("C", 0, 1 << 62)]
    requests = spans(spark, asked).withColumnsRenamed({"start": "request_start", "end": "request_end"})
    got = sorted((r.symbol, r.request_start, r.request_end, r.missing_start, r.missing_end) for r in R.missing(spans(spark, rows), requests, bin_ms).collect())
    want = []
    for s, a, z in set(asked):
        at = a
        for x, y in brute_merge([(b, e) for t, b, e in rows if t == s], 1):
            if y >= a and x <= z:
                want += [(s, a, z, at, x - 1)] if at <= x - 1 else []
                at = max(at, y + 1)
        want += [(s, a, z, at, z)] if at <= z else []
    assert got == sorted(want)


@pytest.mark.parametrize("bin_ms", [60_000, 1_000_000, R.BIN])
def test_islands_of_bars(spark, two, bin_ms):
    got = sorted((r.symbol, r.start, r.end, r.rows) for r in R.covered(two.unionByName(two.where("symbol = 'C'")), bin_ms).collect())
    want = []
    for symbol, part in two.toPandas().groupby("symbol"):
        at = sorted(int(t.timestamp() * 1000) for t in part["timestamp"].dt.tz_localize("UTC"))
        for a, z in brute_merge([(t, t) for t in at], 60_000):
            want.append((symbol, a, z, sum(a <= t <= z for t in at) * (2 if symbol == "C" else 1)))
    assert got == sorted(want)


def test_coverage_of_nothing(spark):
    none = spans(spark, []).where("false")
    requests = spans(spark, [("A", 1, 5)]).withColumnsRenamed({"start": "request_start", "end": "request_end"})
    assert R.merge(none, 1).count() == 0
    assert [(r.missing_start, r.missing_end) for r in R.missing(none, requests).collect()] == [(1, 5)]
    assert R.missing(spans(spark, [("A", 1, 2)]), requests.where("false")).count() == 0


def months(spark, *rows):
    return spark.createDataFrame([("x", s, i, y, m, n, T0, T0) for s, i, y, m, n in rows], catalog.RECORDS)


def held(spark, path, **at):
    return sorted((r.symbol, r.month, r.records) for r in catalog.read(spark, path, **at).collect())


def test_a_catalog_begins_with_an_upsert(spark):
    path = core.scratch_path(spark, "catalog")
    assert held(spark, path) == [] and catalog.version(spark, path) == 0
    catalog.upsert(spark, path, months(spark, ("A", "1d", 2024, 1, 5), ("A", "1d", 2024, 2, 6)))
    catalog.upsert(spark, path, months(spark, ("A", "1d", 2024, 2, 7), ("B", "1d", 2024, 1, 1)))
    assert held(spark, path) == [("A", 1, 5), ("A", 2, 7), ("B", 1, 1)]
    catalog.delete(spark, path, "x", "A")
    assert held(spark, path) == [("B", 1, 1)] and held(spark, path, at=1) == [("A", 1, 5), ("A", 2, 6)]
    catalog.delete(spark, path, "x", "B")
    assert held(spark, path) == [] and catalog.version(spark, path) == 4
    assert catalog.vacuum(spark, path, keep=2) == 2 and held(spark, path, at=3) == [("B", 1, 1)]


def test_a_writer_that_dies_leaves_the_old_catalog(spark, monkeypatch):
    path = core.scratch_path(spark, "catalog")
    catalog.upsert(spark, path, months(spark, ("A", "1d", 2024, 1, 5)))

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(catalog, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            catalog.upsert(spark, path, months(spark, ("A", "1d", 2024, 1, 9)))
    assert held(spark, path) == [("A", 1, 5)] and catalog.version(spark, path) == 1


def test_two_writers_lose_nothing(spark, monkeypatch):
    path = core.scratch_path(spark, "catalog")
    catalog.upsert(spark, path, months(spark, ("A", "1d", 2024, 1, 1)))
    publish, others = catalog._publish, [("B", "1d", 2024, 1, 2), ("C", "1d", 2024, 1, 3)]

    def raced(*args):
        if others:  # another writer is first, twice
            row = others.pop()
            monkeypatch.setattr(catalog, "_publish", publish)
            catalog.upsert(spark, path, months(spark, row))
            monkeypatch.setattr(catalog, "_publish", raced)
        return publish(*args)

    monkeypatch.setattr(catalog, "_publish", raced)
    catalog.upsert(spark, path, months(spark, ("A", "1d", 2024, 1, 9)))
    assert held(spark, path) == [("A", 1, 9), ("B", 1, 2), ("C", 1, 3)] and catalog.version(spark, path) == 4
