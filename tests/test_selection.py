"""Exact quantiles by selection, outliers, compaction by size, and user functions on blocks."""

import datetime as dt

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barsmith import core
from barsmith.functions import registry
from barsmith.operators import indicators as I
from barsmith.operators import quality as C
from barsmith.sources import storage

T0 = dt.datetime(2024, 1, 1)
BARS = "exchange string, symbol string, interval string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, values, symbol="A", step=60):
    return spark.createDataFrame([("x", symbol, "1m", T0 + dt.timedelta(seconds=step * i), *[float(c)] * 4, 1.0) for i, c in enumerate(values)], BARS)


VALUES = {
    "A": np.random.default_rng(1).normal(size=3000).tolist(),
    "B": [5.0] * 700,
    "C": [1.0, 2.0],
    "D": [3.0],
    "E": np.random.default_rng(2).integers(0, 3, 900).astype(float).tolist(),
    "F": (40_000 + np.random.default_rng(3).normal(size=800) * 1e-6).tolist() + [1e300, -1e300, -0.0],
}


@pytest.fixture(scope="module")
def many(spark):
    out = None
    for k, v in VALUES.items():
        out = bars(spark, v, k) if out is None else out.unionByName(bars(spark, v, k))
    none = bars(spark, [1.0], "N").withColumn("close", F.lit(None).cast("double"))
    return core.written(out.unionByName(none).repartition(6), "many")


@pytest.mark.parametrize("ends", [(0.25, 0.75), (0.0, 0.5, 1.0), (0.9,)])
@pytest.mark.parametrize("accuracy", [20, 5000])
def test_quantiles_are_exact(spark, monkeypatch, many, ends, accuracy):
    monkeypatch.setattr(C, "ACCURACY", accuracy)
    got = {r._series.symbol: r._q for r in C.quantiles(many, "close", ends).collect()}
    assert got.keys() == VALUES.keys()
    for k, v in VALUES.items():
        assert got[k] == pytest.approx(np.quantile(v, ends).tolist(), rel=1e-12, abs=1e-12)


def test_a_bracket_that_misses_is_made_good(spark, monkeypatch, many):
    real = C.F.percentile_approx
    monkeypatch.setattr(C.F, "percentile_approx", lambda x, ends, n: real(x, F.array(*[F.lit(0.99)] * 4), n))
    got = {r._series.symbol: r._q for r in C.quantiles(many, "close").collect()}
    monkeypatch.setattr(C, "SHORT", 0)
    kept = C.remove_outliers(many.where("symbol = 'A'"), columns=("close",)).count()
    for k, v in VALUES.items():
        assert got[k] == pytest.approx(np.quantile(v, (0.25, 0.75)).tolist(), rel=1e-12, abs=1e-12)
    a, z = np.quantile(VALUES["A"], (0.25, 0.75))
    assert kept == sum(a - 1.5 * (z - a) <= v <= z + 1.5 * (z - a) for v in VALUES["A"])


@pytest.mark.parametrize("method, factor, short", [("iqr", 1.5, 0), ("iqr", 1.5, 100_000), ("zscore", 1.2, 0)])
def test_outliers_column_after_column(spark, monkeypatch, many, method, factor, short):
    monkeypatch.setattr(C, "SHORT", short)
    df = many.withColumn("volume", F.abs(F.hash("timestamp") % 100).cast("double"))
    got = C.remove_outliers(df, method, factor, ("close", "volume")).toPandas()
    want = []
    for _, part in df.toPandas().groupby("symbol"):
        for c in ("close", "volume"):
            if method == "iqr":
                a, z = part[c].quantile(0.25), part[c].quantile(0.75)
                part = part[(part[c] >= a - factor * (z - a)) & (part[c] <= z + factor * (z - a))]
            elif part[c].std() > 0:
                part = part[(part[c] - part[c].mean()).abs() / part[c].std() < factor]
        want.append(part)
    key = ["symbol", "timestamp"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), pd.concat(want).sort_values(key).reset_index(drop=True)[got.columns], check_dtype=False)
    with pytest.raises(ValueError):
        C.remove_outliers(df, "none")


def test_an_oscillator_report_of_series_without_values(spark, many):
    got = {r.symbol: r for r in I.oscillator_report(many, "close").collect()}
    assert got["N"].all_null and got["N"].n_values == 0 and got["B"].n_extreme == 0 and got["F"].n_extreme == 3


def test_compaction_by_size(spark, tmp_path):
    root, scratch = str(tmp_path / "bars"), str(tmp_path / "scratch")
    both = bars(spark, range(4000), "A", 600).unionByName(bars(spark, range(500), "B", 600))  # A has January alone in one file below
    for k in range(4):
        storage.write_bars(both.where(f"symbol = 'B' AND hour(timestamp) % 4 = {k}"), root, mode="append")
    storage.write_bars(both.where("symbol = 'A'"), root, mode="append")
    before = {r.path: r for r in storage.file_sizes(spark, root).collect()}
    done = storage.compact(spark, root, scratch).collect()
    assert [(r.symbol, r.month, r.files_before, r.files_after) for r in done] == [("B", 1, 4, 1)]
    after = {r.path: r for r in storage.file_sizes(spark, root).collect()}
    assert {p for p in before if before[p].symbol == "A"} == {p for p in after if after[p].symbol == "A"} and sum(r.symbol == "B" for r in after.values()) == 1
    assert storage.read_bars(spark, root).select(*core.SERIES, "timestamp", *core.OHLCV).exceptAll(both.select(*core.SERIES, "timestamp", *core.OHLCV)).count() == 0 and sum(r.rows for r in after.values()) == 4500
    assert storage.compact(spark, root, str(tmp_path / "again")).count() == 0
    largest = max(r.bytes for r in after.values() if r.symbol == "B")
    for k in range(6):
        storage.write_bars(both.where(f"symbol = 'B' AND hour(timestamp) % 6 = {k}").withColumn("symbol", F.lit("C")), root, mode="append")
    parts = storage.compact(spark, root, str(tmp_path / "third"), "symbol = 'C'", target=largest).collect()
    files = storage.file_sizes(spark, root, "symbol = 'C'").collect()
    assert len(parts) == 1 and 1 < parts[0].files_after < 6 and len(files) == parts[0].files_after


def test_row_groups_are_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "ROW_GROUP", 1000)
    storage.write_bars(bars(spark, range(2500), step=60), str(tmp_path / "bars"))
    groups = [pq.ParquetFile(p).metadata for p in tmp_path.glob("bars/**/*.parquet")]
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 1000


def test_user_functions_get_bounded_blocks(spark):
    df = bars(spark, np.random.default_rng(5).normal(size=1000).tolist()).unionByName(bars(spark, [1.0, 2.0, 3.0], "B"))

    def swing(part):
        assert len(part) <= 100 + 2 * 6 and part["timestamp"].is_monotonic_increasing
        return part.assign(swing=part["close"].rolling(7).max() - part["close"].rolling(7).min())

    r = registry.Indicators()
    r.register_pandas("swing", swing, "swing double", history=6, size=100)
    r.register_pandas("whole", lambda p: p.assign(whole=p["close"].rolling(7).max() - p["close"].rolling(7).min()), "whole double")
    got = r.calculate(r.calculate(df, "swing"), "whole").toPandas()
    assert len(got) == 1003 and sorted(got.columns) == sorted([*df.columns, "swing", "whole"])
    np.testing.assert_allclose(got["swing"], got["whole"], equal_nan=True)
