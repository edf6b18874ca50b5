"""Indicators against pandas, edge cases, and isolation of series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsmith import core
from barsmith.functions import registry as R
from barsmith.operators import indicators as I
from barsmith.operators import queries as Q

T0 = dt.datetime(2024, 1, 1)


def bars(spark, closes, symbol="A", step=3600, interval="1h", **other):
    rows = []
    for i, c in enumerate(closes):
        o = {k: v[i] for k, v in other.items()}
        rows.append(("x", symbol, interval, T0 + dt.timedelta(seconds=step * i), o.get("open", c), o.get("high", c), o.get("low", c), c, o.get("volume", 1.0)))
    return spark.createDataFrame(rows, core.BAR_SCHEMA)


def values(df, column, symbol="A"):
    return [r[column] for r in df.where(F.col("symbol") == symbol).orderBy("timestamp").collect()]


def same(got, want, rel=1e-9):
    want = [None if w is None or w != w else float(w) for w in want]
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (w is None or g == pytest.approx(w, rel=rel, abs=1e-9))


@pytest.mark.parametrize("span", [1, 2, 20, 200, 900])
@pytest.mark.parametrize("adjust", [False, True])
def test_ewm_over_many_blocks(spark, span, adjust):
    x = 100 + np.random.default_rng(span).normal(size=2000).cumsum()
    got = values(core.ema(bars(spark, x.tolist(), step=60, interval="1m"), "close", span, "y", adjust), "y")
    same(got, pd.Series(x).ewm(span=span, adjust=adjust).mean())


def test_roll_and_nulls(spark):
    df = bars(spark, [1.0, 2.0, 3.0, 4.0, 5.0]).withColumn("v", F.when(F.col("close") != 3, F.col("close")))
    same(values(df.withColumn("y", core.roll(F.avg, "v", 2)), "y"), [None, 1.5, None, None, 4.5])
    same(values(core.ema(df.withColumn("v", F.when(F.col("close") > 1, F.col("close"))), "v", 3, "y"), "y"), [None, 2, 2.5, 3.25, 4.125])


def test_mean_with_a_hole(spark):
    df = bars(spark, [1.0, 2.0, 3.0, 4.0, 5.0]).withColumn("v", F.when(F.col("close") != 3, F.col("close")))
    same(values(core.ema(df, "v", 3, "y"), "y"), [1, 1.5, 1.5, 19 / 6, 4.0 + 1 / 12])


@pytest.mark.parametrize("span, adjust, share", [(3, False, 0.5), (20, False, 0.9), (200, False, 0.3), (20, True, 0.9), (200, True, 0.3)])
def test_means_with_holes(spark, span, adjust, share):
    rng = np.random.default_rng(span)
    x = 100 + rng.normal(size=1500).cumsum()
    x[rng.random(1500) < share] = np.nan
    x[:5], x[511:513], x[700:1100] = np.nan, np.nan, np.nan
    df = bars(spark, [float(i) for i in range(1500)], step=60, interval="1m")
    df = df.withColumn("v", F.element_at(F.array(*[F.lit(None if v != v else float(v)).cast("double") for v in x]), F.col("close").cast("int") + 1))
    same(values(core.ema(df, "v", span, "y", adjust), "y"), pd.Series(x).ewm(span=span, adjust=adjust).mean())


def test_a_hole_after_many_rows_keeps_a_constant(spark):
    df = bars(spark, [float(i) for i in range(1100)], step=60, interval="1m").withColumn("v", F.when(F.col("close") != 512, F.lit(100.0)))
    same(values(core.ema(df, "v", 200, "y"), "y"), [100.0] * 1100)


def test_long_series_in_blocks(spark):
    x = (100 + np.random.default_rng(1).normal(size=900).cumsum()).tolist()
    both = bars(spark, x, "A", step=7200).unionByName(bars(spark, x[::-1][:430], "B", step=7200))

    def f(df):
        return I.macd(I.bollinger(I.rsi(df)))

    history = core.reach(core.span_alpha(26)) + core.reach(core.span_alpha(9)) + 1
    parted = core.in_blocks(both, f, history, size=150)
    assert parted.columns == f(both).columns
    for s in "AB":
        for c in ("rsi_14", "boll_upper", "macd", "macd_signal"):
            same(values(parted, c, s), values(f(both), c, s))


def test_many_means_share_one_sort(spark):
    plan = R.add_common(bars(spark, [1.0, 2.0]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 2 and plan.count("Exchange hashpartitioning") <= 1


def test_known_sma(spark):
    same(values(I.sma(bars(spark, [10.0 * i for i in range(1, 11)]), 5), "sma_5"), [None] * 4 + [30, 40, 50, 60, 70, 80])


def test_constant_and_rising_prices(spark):
    flat = bars(spark, [5.0] * 30)
    flat = I.cci(I.stochastic(I.bollinger(I.rsi(flat))))
    assert values(I.ad(flat), "ad")[-1] == 0.0
    for c in ("rsi_14", "boll_pct_b", "stoch_k", "cci_20"):
        assert set(values(flat, c)) == {None}
    up = I.rsi_cutler(I.rsi(bars(spark, [float(i) for i in range(1, 31)])))
    assert values(up, "rsi_14")[1:] == [100.0] * 29 and values(up, "rsi_cutler_14")[-1] == 0.0


def test_series_do_not_leak(spark):
    a, b = [float(i % 7 + 1) for i in range(60)], [float(i % 5 + 50) for i in range(60)]
    kw = lambda x: {"high": [v + 1 for v in x], "low": [v - 1 for v in x], "volume": [v * 2 for v in x]}
    both = bars(spark, a, "A", **kw(a)).unionByName(bars(spark, b, "B", **kw(b)))
    for name in ("sma", "ema", "boll", "macd", "rsi", "stoch", "atr", "obv", "mfi", "hma", "kc", "force_index"):
        f = R.BUILT_IN[name]
        cols = [c for c in f(both).columns if c not in both.columns]
        for s, x in (("A", a), ("B", b)):
            alone = f(bars(spark, x, s, **kw(x)))
            for c in cols:
                same(values(f(both), c, s), values(alone, c, s))


def test_smoothing_and_peaks(spark):
    x = [float(v) for v in (1, 3, 2, 5, 4, 6, 8, 7, 9, 1)]
    got = values(I.smooth(bars(spark, x), "close", "savgol", 5), "close_smooth")
    fit = [float(np.polyval(np.polyfit(range(5), x[min(max(i - 2, 0), 5) : min(max(i - 2, 0), 5) + 5], 2), i - min(max(i - 2, 0), 5))) for i in range(10)]
    same(got, fit, rel=1e-7)
    df = I.peaks(bars(spark, x), "close", 2)
    assert [i for i, p in enumerate(values(df, "is_peak")) if p] == [8] and [i for i, p in enumerate(values(df, "is_trough")) if p] == []


def test_parameters_are_checked(spark):
    df = bars(spark, [1.0, 2.0, 3.0])
    for bad in (lambda: I.sma(df, 0), lambda: I.sma(df, 3, strict=True), lambda: I.macd(df, 26, 12), lambda: I.bollinger(df, 20, 0), lambda: I.sma(df, 2, "missing"), lambda: I.moving_average(df, 2, "none"), lambda: I.choppiness(df, 1), lambda: Q.aggregated(df, "mode"), lambda: core.bucket(F.col("timestamp"), "7x")):
        with pytest.raises(ValueError):
            bad()
    with pytest.warns(UserWarning):
        assert "RSI_2" in R.from_specs(df, ["RSI_2", "KDJ"]).columns
    assert len(R.Indicators().names()) == 34


def test_week_and_month_labels(spark):
    times = [dt.datetime(2024, 1, 3, 5), dt.datetime(2024, 1, 7, 23), dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 20, 1)]
    df = spark.createDataFrame([("x", "A", "1h", t, 1.0, 1.0, 1.0, 1.0, 2.0) for t in times], core.BAR_SCHEMA)
    weeks = [(r.timestamp.strftime("%m-%d"), r.volume) for r in Q.aggregated(df, "sum", "W").orderBy("timestamp").collect()]
    assert weeks == [("01-07", 4.0), ("01-14", 2.0), ("01-21", 2.0)]
    assert [r.timestamp.strftime("%m-%d") for r in Q.aggregated(df, "sum", "M").collect()] == ["01-31"]


def test_before_takes_closed_bars_only(spark):
    df = bars(spark, [1.0, 2.0, 3.0])
    assert [r.close for r in Q.before(df, "2024-01-01 03:00:00", 2).orderBy("timestamp").collect()] == [2.0, 3.0]
    assert [r.close for r in Q.before(df, "2024-01-01 02:59:59.999", 3).orderBy("timestamp").collect()] == [1.0, 2.0]
    with pytest.raises(Exception):
        Q.where_text(df, "close >>> 1").count()
