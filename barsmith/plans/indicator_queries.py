"""Queries of the indicators and series utilities over all symbols."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import prev
from ..functions import registry as R
from ..operators import indicators as I
from .tables import OVER, add, hourly, layers, on_bars, rows, sdiv, sema, semadj, sewm, shown, shown_sql, slag, sroll, swma, H

TP = "((high + low + close) / 3.0::DOUBLE)"
TR = f"greatest(high - low, abs(high - {slag('close')}), abs(low - {slag('close')}))"
D1 = f"(close - {slag('close')})"
CLV = f"coalesce({sdiv('(close - low) - (high - close)', 'high - low')}, 0)"
GAIN, LOSS = f"CASE WHEN {D1} > 0 THEN {D1} ELSE 0.0::DOUBLE END", f"CASE WHEN {D1} < 0 THEN -{D1} ELSE 0.0::DOUBLE END"


def strength(g: str, l: str) -> str:
    return f"CASE WHEN {l} = 0 AND {g} > 0 THEN 100.0::DOUBLE ELSE 100 - {sdiv('100', f'1 + {sdiv(g, l)}')} END"


def cross(name_up: str, name_down: str, a: str, b: str) -> dict[str, str]:
    return {name_up: f"coalesce({slag(a)} <= {slag(b)} AND {a} > {b}, false)", name_down: f"coalesce({slag(a)} >= {slag(b)} AND {a} < {b}, false)"}


# Moving averages
on_bars("m1_sma", lambda b: I.sma(b, 20), [{"sma_20": sroll("avg", "close", 20)}], "sma_20")
on_bars("m2_ema", lambda b: I.ema_ma(b, 20), [{"ema_20": sema("close", 20)}], "ema_20")
on_bars("m3_wma", lambda b: I.wma(b, 20), [{"wma_20": swma("close", 20)}], "wma_20")
on_bars("m4_dema", lambda b: I.dema(b, 20), [{"e1": sema("close", 20)}, {"e2": sema("e1", 20)}, {"dema_20": "2 * e1 - e2"}], "dema_20")
on_bars("m5_tema", lambda b: I.tema(b, 20), [{"e1": sema("close", 20)}, {"e2": sema("e1", 20)}, {"e3": sema("e2", 20)}, {"tema_20": "3 * e1 - 3 * e2 + e3"}], "tema_20")
on_bars("m6_vwma", lambda b: I.vwma(b, 20), [{"pv": "close * volume"}, {"vwma_20": sdiv(sroll("sum", "pv", 20), sroll("sum", "volume", 20))}], "vwma_20")
on_bars("m7_hma", lambda b: I.hma(b, 20), [{"raw": f"2 * {swma('close', 10)} - {swma('close', 20)}"}, {"hma_20": swma("raw", 4)}], "hma_20")
on_bars("m8_calculate_ma", lambda b: I.moving_average(b, 10, "WMA"), [{"wma_10": swma("close", 10)}], "wma_10")
on_bars("m9_multiple_ma", lambda b: I.moving_averages(b), [{f"sma_{n}": sroll("avg", "close", n) for n in (5, 10, 20, 50, 200)}], "sma_5 sma_10 sma_20 sma_50 sma_200")
on_bars("m10_volume_ma", lambda b: I.volume_ma(b, 20), [{"volume_ma_20": sroll("avg", "volume", 20)}], "volume_ma_20")

# Bands
BOLL = [{"boll_middle": sroll("avg", "close", 20), "sd": sroll("stddev_samp", "close", 20)}, {"boll_upper": "boll_middle + 2 * sd", "boll_lower": "boll_middle - 2 * sd"}, {"boll_width": "boll_upper - boll_lower"}, {"boll_pct_b": sdiv("close - boll_lower", "boll_width")}]
BOLL_COLS = "boll_middle boll_upper boll_lower boll_width boll_pct_b"
KC = [{"kc_middle": sema("close", 20), "kc_tr": TR}, {"kc_atr": sema("kc_tr", 10)}, {"kc_upper": "kc_middle + 2 * kc_atr", "kc_lower": "kc_middle - 2 * kc_atr"}, {"kc_width": "kc_upper - kc_lower"}]
DC = [{"dc_upper": sroll("max", "high", 20), "dc_lower": sroll("min", "low", 20)}, {"dc_middle": "(dc_upper + dc_lower) / 2", "dc_width": "dc_upper - dc_lower"}]
SIGNALS = {
    "boll_breakout_up": "coalesce(close > boll_upper, false)", "boll_breakout_down": "coalesce(close < boll_lower, false)",
    "boll_return_from_up": f"coalesce({slag('close')} > {slag('boll_middle')} AND close <= boll_middle, false)", "boll_return_from_down": f"coalesce({slag('close')} < {slag('boll_middle')} AND close >= boll_middle, false)",
    "boll_squeeze": f"coalesce(boll_width < 0.5 * {sroll('avg', 'boll_width', 20)}, false)",
}
on_bars("b1_bollinger", lambda b: I.bollinger(b), BOLL, BOLL_COLS)
on_bars("b2_bollinger_signals", lambda b: I.bollinger_signals(b), [*BOLL, SIGNALS], " ".join(f"!{k}" for k in SIGNALS))
on_bars("b3_keltner", lambda b: I.keltner(b), KC, "kc_middle kc_upper kc_lower kc_width")
on_bars("b4_donchian", lambda b: I.donchian(b), DC, "dc_upper dc_middle dc_lower dc_width")
on_bars("b5_compare_bands", lambda b: I.compare_bands(b), [*BOLL, *KC, *DC], "boll_upper boll_lower kc_upper kc_lower dc_upper dc_lower")

# Trend
MACD = [{"ef": sema("close", 12), "es": sema("close", 26)}, {"macd": "ef - es"}, {"macd_signal": sema("macd", 9)}, {"macd_histogram": "macd - macd_signal"}]
MACD_COLS = "macd macd_signal macd_histogram"
MSIG = cross("macd_golden_cross", "macd_death_cross", "macd", "macd_signal") | {
    "macd_zero_cross_up": f"coalesce({slag('macd')} <= 0 AND macd > 0, false)", "macd_zero_cross_down": f"coalesce({slag('macd')} >= 0 AND macd < 0, false)",
    "macd_hist_positive": f"coalesce({slag('macd_histogram')} <= 0 AND macd_histogram > 0, false)", "macd_hist_negative": f"coalesce({slag('macd_histogram')} >= 0 AND macd_histogram < 0, false)",
}
on_bars("t1_macd", lambda b: I.macd(b), MACD, MACD_COLS)
on_bars("t2_macd_signals", lambda b: I.macd_signals(b), [*MACD, MSIG], " ".join(f"!{k}" for k in MSIG))
on_bars("t3_macd_divergence", lambda b: I.macd_signals(b), [{"macd_bearish_divergence": "false", "macd_bullish_divergence": "false"}], "!macd_bearish_divergence !macd_bullish_divergence")
on_bars("t4_ppo", lambda b: I.ppo(b), [{"ef": sema("close", 12), "es": sema("close", 26)}, {"ppo": f"100 * {sdiv('ef - es', 'es')}"}, {"ppo_signal": sema("ppo", 9)}, {"ppo_histogram": "ppo - ppo_signal"}], "ppo ppo_signal ppo_histogram")
on_bars("t5_apo", lambda b: I.apo(b), [{"apo": f"{sema('close', 12)} - {sema('close', 26)}"}], "apo")
on_bars(
    "t6_adx",
    lambda b: I.adx(b),
    [
        {"u": f"high - {slag('high')}", "d": f"{slag('low')} - low", "trr": TR},
        {"pdm": "CASE WHEN u > d AND u > 0 THEN u ELSE 0.0::DOUBLE END", "mdm": "CASE WHEN d > u AND d > 0 THEN d ELSE 0.0::DOUBLE END"},
        {"atr_": sroll("avg", "trr", 14)},
        {"pdi": f"100 * {sdiv(sroll('avg', 'pdm', 14), 'atr_')}", "mdi": f"100 * {sdiv(sroll('avg', 'mdm', 14), 'atr_')}"},
        {"dx": f"100 * {sdiv('abs(pdi - mdi)', 'pdi + mdi')}"},
        {"adx": sroll("avg", "dx", 14)},
    ],
    "adx",
)

# Momentum
RSI = [{"g": GAIN, "l": LOSS}, {"ag": sema("g", 14), "al": sema("l", 14)}, {"rsi_14": strength("ag", "al")}]
on_bars("o1_rsi", lambda b: I.rsi(b), RSI, "rsi_14")
RSIG = {
    "rsi_oversold": "coalesce(rsi_14 < 30, false)", "rsi_overbought": "coalesce(rsi_14 > 70, false)",
    "rsi_cross_up_oversold": f"coalesce({slag('rsi_14')} < 30 AND rsi_14 >= 30, false)", "rsi_cross_down_overbought": f"coalesce({slag('rsi_14')} > 70 AND rsi_14 <= 70, false)",
}
on_bars("o2_rsi_signals", lambda b: I.rsi_signals(b), [*RSI, RSIG], " ".join(f"!{k}" for k in RSIG))
on_bars("o3_rsi_wilder", lambda b: I.rsi_wilder(b).withColumnRenamed("RSI_14", "rsi_wilder_14"), [{"g": GAIN, "l": LOSS}, {"ag": sewm("g", 1 / 14), "al": sewm("l", 1 / 14)}, {"rsi_wilder_14": strength("ag", "al")}], "rsi_wilder_14")
on_bars(
    "o4_rsi_class",
    lambda b: (lambda d: d.withColumn("rsi_class", I.rsi_class(F.round("rsi_14", 6))))(I.rsi(b)),
    [*RSI, {"rr": "round(rsi_14, 6)"}, {"rsi_class": "CASE WHEN rr > 70 THEN 'overbought' WHEN rr < 30 THEN 'oversold' WHEN rr > 50 THEN 'bullish' WHEN rr IS NOT NULL THEN 'bearish' END"}],
    "!rsi_class",
)
add("o5_rsi_divergence", lambda s, sf: I.rsi_divergence(hourly(s, sf)).drop("exchange", "interval"), "SELECT DISTINCT event_type AS symbol, false AS bullish_divergence, false AS bearish_divergence, 'neutral' AS divergence FROM events")
on_bars("o6_rsi_cutler", lambda b: I.rsi_cutler(b), [{"g": GAIN, "l": LOSS}, {"ag": sroll("avg", "g", 14), "al": sroll("avg", "l", 14)}, {"rsi_cutler_14": f"100 - 100 / (1 + CASE WHEN al = 0 THEN 0 ELSE {sdiv('ag', 'al')} END)"}], "rsi_cutler_14")
STOCH = [{"hh": sroll("max", "high", 14), "ll": sroll("min", "low", 14)}, {"k0": f"100 * {sdiv('close - ll', 'hh - ll')}"}, {"stoch_k": sroll("avg", "k0", 3)}, {"stoch_d": sroll("avg", "stoch_k", 3)}]
on_bars("o7_stochastic", lambda b: I.stochastic(b), STOCH, "stoch_k stoch_d")
SSIG = cross("stoch_golden_cross", "stoch_death_cross", "sk", "sd")
on_bars(
    "o8_stochastic_signals",
    lambda b: I.stochastic_signals(b),
    [*STOCH, {"sk": "stoch_k", "sd": "stoch_d"}, SSIG, {"stoch_oversold_cross": "stoch_golden_cross AND coalesce(sk < 20, false)", "stoch_overbought_cross": "stoch_death_cross AND coalesce(sk > 80, false)"}],
    "!stoch_golden_cross !stoch_death_cross !stoch_oversold_cross !stoch_overbought_cross",
)
CCI = [{"tp": TP}, {"ma": sroll("avg", "tp", 20), "held": f"list(tp) {rows(20)}"}, {"dev": "CASE WHEN ma IS NOT NULL THEN list_sum(list_transform(held, lambda v: abs(v - ma))) / 20 END"}, {"cci_20": sdiv("tp - ma", "0.015::DOUBLE * dev")}]
on_bars("o9_cci", lambda b: I.cci(b), CCI, "cci_20")
on_bars("o10_williams_r", lambda b: I.williams_r(b), [STOCH[0], {"williams_r_14": f"-100 * {sdiv('hh - close', 'hh - ll')}"}], "williams_r_14")
on_bars("o11_roc", lambda b: I.roc(b), [{"roc_12": f"100 * {sdiv(f'close - {slag("close", 12)}', slag('close', 12))}"}], "roc_12")
on_bars("o12_mom", lambda b: I.mom(b), [{"mom_10": f"close - {slag('close', 10)}"}], "mom_10")
add(
    "o13_oscillator_report",
    lambda s, sf: I.oscillator_report(I.roc(hourly(s, sf)).withColumn("roc_12", F.round("roc_12", 6)), "roc_12").drop("exchange", "interval"),
    layers({"x": f"round(100 * {sdiv(f'close - {slag("close", 12)}', slag('close', 12))}, 6)"}).format("symbol, x")
    .join(["SELECT symbol, count(x) AS n_values, count(*) - count(x) AS n_null, count(*) FILTER (WHERE x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1)) AS n_extreme, count(x) = 0 AS all_null FROM (SELECT *, quantile_cont(x, 0.25) OVER (PARTITION BY symbol) AS q1, quantile_cont(x, 0.75) OVER (PARTITION BY symbol) AS q3 FROM (", ")) GROUP BY symbol"]),
)

# Volatility
ATR = [{"tr": TR}, {"atr_14": sema("tr", 14)}]
on_bars("v1_atr", lambda b: I.atr(b), ATR, "atr_14 tr")
on_bars("v2_natr", lambda b: I.natr(b), [*ATR, {"natr_14": f"100 * {sdiv('atr_14', 'close')}"}], "natr_14 atr_14", digits=4)
on_bars("v3_atrp", lambda b: I.atrp(b), [*ATR, {"atrp_14": f"100 * {sdiv('atr_14', 'close')}"}], "atrp_14", digits=4)
on_bars("v4_std", lambda b: I.standard_deviation(b), [{"std_20": sroll("stddev_samp", "close", 20)}], "std_20")
on_bars("v5_historical_volatility", lambda b: I.historical_volatility(b), [{"r": f"ln({sdiv('close', slag('close'))})"}, {"hv_20": f"{sroll('stddev_samp', 'r', 20)} * {math.sqrt(252)!r}::DOUBLE * 100"}], "hv_20")
on_bars("v6_ulcer_index", lambda b: I.ulcer_index(b), [{"t": sroll("max", "close", 14)}, {"dd": f"pow(100 * {sdiv('close - t', 't')}, 2)"}, {"ui_14": f"sqrt({sroll('avg', 'dd', 14)})"}], "ui_14")
on_bars("v7_mass_index", lambda b: I.mass_index(b), [{"hl": "high - low"}, {"e1": sema("hl", 9)}, {"e2": sema("e1", 9)}, {"rt": sdiv("e1", "e2")}, {"mass_index": sroll("sum", "rt", 25)}], "mass_index")
on_bars("v8_choppiness", lambda b: I.choppiness(b), [{"trr": TR, "hh": sroll("max", "high", 14), "ll": sroll("min", "low", 14)}, {"ra": sdiv(sroll("sum", "trr", 14), "hh - ll")}, {"ci_14": f"100 * log10(CASE WHEN ra > 0 THEN ra END) / {math.log10(14)!r}::DOUBLE"}], "ci_14")
on_bars("v9_atr_simple", lambda b: I.atr_simple(b), [{"trr": TR}, {"atr_simple_14": sroll("avg", "trr", 14)}], "atr_simple_14")

# Volume
CUM = "OVER (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING)"
OBV = [{"sv": f"coalesce(sign({D1}), 0) * volume"}, {"obv": f"sum(sv) {CUM}"}]
on_bars("u1_obv", lambda b: I.obv(b), OBV, "obv", digits=4)
on_bars("u2_vwap", lambda b: I.vwap(b), [{"m": f"{TP} * volume"}, {"vwap": sdiv(f"sum(m) {CUM}", f"sum(volume) {CUM}")}], "vwap")
MFI = [{"tp": TP}, {"lt": slag("tp")}, {"pf": "CASE WHEN tp > lt THEN tp * volume ELSE 0.0::DOUBLE END", "nf": "CASE WHEN tp < lt THEN tp * volume ELSE 0.0::DOUBLE END"}, {"ps": sroll("sum", "pf", 14), "ns": sroll("sum", "nf", 14)}, {"mfi_14": strength("ps", "ns")}]
on_bars("u3_mfi", lambda b: I.mfi(b), MFI, "mfi_14")
on_bars("u4_ad", lambda b: I.ad(b), [{"cv": f"{CLV} * volume"}, {"ad": f"sum(cv) {CUM}"}], "ad", digits=4)
on_bars("u5_cmf", lambda b: I.cmf(b), [{"cv": f"{CLV} * volume"}, {"cmf_20": sdiv(sroll("sum", "cv", 20), sroll("sum", "volume", 20))}], "cmf_20")
on_bars("u6_emv", lambda b: I.emv(b), [{"mid": "(high + low) / 2"}, {"emv": sdiv(f"mid - {slag('mid')}", sdiv("volume", "high - low"))}, {"emv_ma_14": sroll("avg", "emv", 14)}], "emv emv_ma_14")
on_bars("u7_force_index", lambda b: I.force_index(b), [{"force_index": f"{D1} * volume"}, {"force_index_ema_13": sema("force_index", 13)}], "force_index force_index_ema_13", digits=4)
add(
    "u8_volume_report",
    lambda s, sf: I.volume_report(hourly(s, sf)).drop("exchange", "interval"),
    H + " SELECT symbol, coalesce(bool_or(volume < 0), false) AS has_negative, coalesce(avg((volume = 0)::INT::DOUBLE), 0) AS zero_share, coalesce(avg((volume = 0)::INT::DOUBLE) > 0.1, false) AS many_zero FROM b GROUP BY symbol",
)

# Series utilities
on_bars("w1_returns", lambda b: I.returns(I.returns(b, "close", 1), "close", 3, "log"), [{"close_return_1": f"{sdiv('close', slag('close'))} - 1", "close_return_3": f"ln({sdiv('close', slag('close', 3))})"}], "close_return_1 close_return_3")
STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median", "sum": "sum"}
on_bars("w2_rolling_stats", lambda b: I.rolling_stats(b, "close", 10), [{f"close_rolling_{k}_10": sroll(f, "close", 10) for k, f in STATS.items()}], " ".join(f"close_rolling_{k}_10" for k in STATS))


def _crossed(b: DataFrame, up: bool) -> DataFrame:
    b = I.moving_averages(b, (5, 20))
    return I.crossover(b, "sma_5", "sma_20") if up else I.crossunder(b, "sma_5", "sma_20")


for _name, _up, _sign in (("crossover", True, ">"), ("crossunder", False, "<")):
    on_bars(f"w{3 if _up else 4}_{_name}", lambda b, up=_up: _crossed(b, up), [{"a": sroll("avg", "close", 5), "z": sroll("avg", "close", 20)}, {"o": f"coalesce(a {_sign} z, false)"}, {_name: f"o AND NOT coalesce({slag('o')}, false)"}], f"!{_name}")
BEF, AFT = ("OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)", "OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)")
on_bars(
    "w5_peaks",
    lambda b: I.peaks(b, "close", 3, 10.0),
    [{"m": "avg(close) OVER (PARTITION BY symbol)"}, {"is_peak": f"coalesce(close > max(close) {BEF} AND close > max(close) {AFT}, false) AND close > m + 10", "is_trough": f"coalesce(close < min(close) {BEF} AND close < min(close) {AFT}, false) AND close < m - 10"}],
    "!is_peak !is_trough",
)
W5 = [I._savgol(5, k) for k in range(5)]


def _sg(k: int) -> str:
    """Value at place ``k`` of the parabola through the five rows around."""
    return " + ".join(f"({c!r}::DOUBLE * " + (f"lag(close, {k - i}) {OVER}" if i < k else f"lead(close, {i - k}) {OVER}" if i > k else "close") + ")" for i, c in enumerate(W5[k]))


on_bars(
    "w6_smooth",
    lambda b: I.smooth(I.smooth(I.smooth(b, "close", "sma", 5, "smooth_sma"), "close", "ema", 5, "smooth_ema"), "close", "savgol", 5, "smooth_savgol"),
    [
        {"rn": f"row_number() {OVER}", "cn": "count(*) OVER (PARTITION BY symbol)"},
        {"smooth_sma": sroll("avg", "close", 5), "smooth_ema": semadj("close", 5), "smooth_savgol": f"CASE WHEN rn = 1 THEN {_sg(0)} WHEN rn = 2 THEN {_sg(1)} WHEN rn = cn THEN {_sg(4)} WHEN rn = cn - 1 THEN {_sg(3)} ELSE {_sg(2)} END"},
    ],
    "smooth_sma smooth_ema smooth_savgol",
)


def _holes(b: DataFrame) -> DataFrame:
    """Bars whose flat hours have no price range."""
    return b.withColumn("span", F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")))


def _filled(b: DataFrame) -> DataFrame:
    b = _holes(b)
    for m in ("ffill", "bfill", "zero", "mean"):
        b = I.fill(b.withColumn(m, F.col("span")), m, [m])
    return b


FWD = "OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
SPAN = {"span": "CASE WHEN high > low THEN high - low END"}
on_bars("w7_fill", _filled, [SPAN, {"ffill": f"last_value(span IGNORE NULLS) {CUM}", "bfill": f"first_value(span IGNORE NULLS) {FWD}", "zero": "coalesce(span, 0)", "mean": "coalesce(span, avg(span) OVER (PARTITION BY symbol))"}], "ffill bfill zero mean")
on_bars("w8_drop_nulls", lambda b: I.drop_nulls(_holes(b), ["span"]), [SPAN], "span", tail="WHERE span IS NOT NULL")
on_bars("w9_normalize_columns", lambda b: I.normalize_columns(b.withColumnsRenamed({"open": "Open", "close": "Adj Close", "timestamp": "Date"})), [], "open high low close")

# Registry and presets
on_bars("p1_specs", lambda b: R.from_specs(b, ["MA_20", "SMA_10", "EMA_12", "RSI_14", "BOLL_20", "MACD"]).withColumnsRenamed({"MA_20": "spec_ma", "SMA_10": "spec_sma", "EMA_12": "spec_ema", "RSI_14": "spec_rsi"}), [*RSI, *BOLL, *MACD, {"spec_ma": sroll("avg", "close", 20), "spec_sma": sroll("avg", "close", 10), "spec_ema": sema("close", 12), "spec_rsi": "rsi_14"}], f"spec_ma spec_sma spec_ema spec_rsi {BOLL_COLS} {MACD_COLS}")
on_bars("p2_registry", lambda b: R.Indicators().calculate(b, "williams_r", period=14), [STOCH[0], {"williams_r_14": f"-100 * {sdiv('hh - close', 'hh - ll')}"}], "williams_r_14")


def _many(b: DataFrame) -> DataFrame:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return R.Indicators().calculate_many(b, {"sma": {"period": 10}, "missing": {}, "momentum": {"period": 10}})


on_bars("p3_calculate_multiple", _many, [{"sma_10": sroll("avg", "close", 10), "mom_10": f"close - {slag('close', 10)}"}], "sma_10 mom_10")
on_bars("p4_pipeline", lambda b: R.Indicators().pipeline([("sma", {"period": 7}), ("roc", {"period": 3})])(b), [{"sma_7": sroll("avg", "close", 7), "roc_3": f"100 * {sdiv(f'close - {slag("close", 3)}', slag('close', 3))}"}], "sma_7 roc_3")


def _custom(b: DataFrame) -> DataFrame:
    r = R.Indicators()
    r.register("spread", lambda df: df.withColumn("spread", F.col("high") - F.col("low")))
    r.register("climb", lambda df: df.withColumn("climb", F.col("close") - prev("close")))
    return r.calculate(r.calculate(b, "spread"), "climb")


on_bars("p5_custom", _custom, [{"spread": "high - low", "climb": D1}], "spread climb")


def _custom_pandas(b: DataFrame) -> DataFrame:
    """A user's rolling function in pandas, on blocks of 500 bars with the four before."""
    r = R.Indicators()
    r.register_pandas("swing", lambda part: part.assign(swing=part["high"].rolling(5).max() - part["low"].rolling(5).min()), "swing double", history=4, size=500)
    return r.calculate(b, "swing")


on_bars("p5_custom_pandas", _custom_pandas, [{"swing": f"{sroll('max', 'high', 5)} - {sroll('min', 'low', 5)}"}], "swing")
on_bars("p6_common", lambda b: R.add_common(b), [*RSI, *BOLL, *MACD, *ATR, *OBV, {**{f"sma_{n}": sroll("avg", "close", n) for n in (5, 10, 20, 50)}, **{f"ema_{n}": sema("close", n) for n in (5, 10, 20, 50)}, "volume_ma_20": sroll("avg", "volume", 20)}], f"sma_5 sma_50 ema_5 ema_50 {MACD_COLS} rsi_14 {BOLL_COLS} atr_14 volume_ma_20 obv", digits=4)
on_bars("p7_trend", lambda b: R.add_trend(b), [*MACD, {f"ema_{n}": sema("close", n) for n in (20, 50, 200)}], f"ema_20 ema_50 ema_200 {MACD_COLS}")
on_bars("p8_momentum", lambda b: R.add_momentum(b), [*RSI, *STOCH, *CCI, {"roc_12": f"100 * {sdiv(f'close - {slag("close", 12)}', slag('close', 12))}"}], "rsi_14 stoch_k stoch_d cci_20 roc_12")
on_bars("p9_volatility", lambda b: R.add_volatility(b), [*ATR, *BOLL, {"std_20": sroll("stddev_samp", "close", 20)}], f"atr_14 {BOLL_COLS} std_20")
on_bars("p10_volume", lambda b: R.add_volume(b), [*OBV, *MFI, {"m": f"{TP} * volume"}, {"vwap": sdiv(sroll("sum", "m", 20), sroll("sum", "volume", 20))}], "obv vwap mfi_14", digits=4)
on_bars("p11_adjusted", lambda b: I.macd(I.ema(b, "close", 20, "ema_adjusted_20", adjust=True), adjust=True), [{"ema_adjusted_20": semadj("close", 20), "macd": f"{semadj('close', 12)} - {semadj('close', 26)}"}, {"macd_signal": semadj("macd", 9)}, {"macd_histogram": "macd - macd_signal"}], f"ema_adjusted_20 {MACD_COLS}")
CCI14 = [{"tp": TP}, {"ma": sroll("avg", "tp", 14), "held": f"list(tp) {rows(14)}"}, {"dev": "CASE WHEN ma IS NOT NULL THEN list_sum(list_transform(held, lambda v: abs(v - ma))) / 14 END"}, {"cci_14": sdiv("tp - ma", "0.015::DOUBLE * dev")}]
on_bars("p12_fallbacks", lambda b: I.cci(I.obv(I.stochastic(I.bollinger(I.sma(b, 20)))), 14), [*BOLL, *STOCH, *OBV, *CCI14, {"sma_20": sroll("avg", "close", 20)}], "sma_20 boll_upper stoch_k obv cci_14", digits=4)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Last 24 hourly bars of each symbol with SMA and Bollinger bands."""
    from ..operators.queries import newest

    return shown(newest(I.bollinger(I.sma(hourly(spark, sf), 20)), 24), f"close sma_20 {BOLL_COLS}")


add("flagship", flagship, layers(*BOLL, {"sma_20": sroll("avg", "close", 20), "back": "row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC)"}).format(shown_sql(f"close sma_20 {BOLL_COLS}")) + " WHERE back <= 24")
