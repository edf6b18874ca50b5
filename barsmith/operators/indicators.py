"""Technical indicators as DataFrame functions: bars of any number of series in, named columns added.

All use windows of one specification, exponential means (``core.ewms``) too; none
leaves the JVM. Price ranges of zero and other 0/0 cases give null unless said
otherwise.
"""

from __future__ import annotations

import math
import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import SERIES, check, check_period, div, ema, emas, ewms, flag, framed, num, prev, roll, rows, running, series, true_range, typical
from .quality import quantiles

# ------------------------------------------------------- moving averages


def sma(df: DataFrame, period: int = 20, column: str = "close", name: str | None = None, strict: bool = False) -> DataFrame:
    check(df, column)
    check_period(df, period, strict)
    return df.withColumn(name or f"sma_{period}", roll(F.avg, column, period))


def ema_ma(df: DataFrame, period: int = 20, column: str = "close", name: str | None = None, strict: bool = False) -> DataFrame:
    check(df, column)
    check_period(df, period, strict)
    return ema(df, column, period, name or f"ema_{period}")


def weighted(df: DataFrame, wanted: dict[str, tuple[str | Column, int]]) -> DataFrame:
    """Means with linear weights by name: (values, n), the newest of the last n values weighs n.

    Three sums of the frame, none of them growing with the series: of the
    values, of the values by their place modulo P, and of those in the upper
    half of the places, which lie a turn back where a frame wraps around.
    """
    turn = 1 << (2 * max(n for _, n in wanted.values())).bit_length()
    df = df.withColumns({f"_v_{name}": num(x).cast("double") for name, (x, _) in wanted.items()}).withColumn("_turn", (F.row_number().over(series()) % turn).cast("double"))
    out = {}
    for name, (_, n) in wanted.items():
        x, place = F.col(f"_v_{name}"), F.col("_turn")
        total, moment, upper = (F.sum(v).over(rows(n)) for v in (x, place * x, F.when(place >= turn // 2, x).otherwise(0.0)))
        wrapped = F.when(place < n - 1, upper * float(turn)).otherwise(0.0)
        out[name] = F.when(F.count(x).over(rows(n)) == n, (moment + (n - place) * total - wrapped) / (n * (n + 1) / 2.0))
    return df.withColumns(out).drop("_turn", *[f"_v_{name}" for name in wanted])


def wma(df: DataFrame, period: int = 20, column: str = "close", name: str | None = None, strict: bool = False) -> DataFrame:
    check(df, column)
    check_period(df, period, strict)
    return weighted(df, {name or f"wma_{period}": (column, period)})


def same(x):
    return x


def dema(df: DataFrame, period: int = 20, column: str = "close", name: str | None = None, strict: bool = False) -> DataFrame:
    check(df, column)
    check_period(df, period, strict)
    df = emas(df, {"_e1": (column, period)}, then={"_e2": (("_e1",), same, period)})
    return df.withColumn(name or f"dema_{period}", 2 * F.col("_e1") - F.col("_e2")).drop("_e1", "_e2")


def tema(df: DataFrame, period: int = 20, column: str = "close", name: str | None = None, strict: bool = False) -> DataFrame:
    check(df, column)
    check_period(df, period, strict)
    df = emas(df, {"_e1": (column, period)}, then={"_e2": (("_e1",), same, period), "_e3": (("_e2",), same, period)})
    return df.withColumn(name or f"tema_{period}", 3 * F.col("_e1") - 3 * F.col("_e2") + F.col("_e3")).drop("_e1", "_e2", "_e3")


def vwma(df: DataFrame, period: int = 20, column: str = "close", name: str | None = None, strict: bool = False) -> DataFrame:
    check(df, column, "volume")
    check_period(df, period, strict)
    return df.withColumn(name or f"vwma_{period}", div(roll(F.sum, F.col(column) * F.col("volume"), period), roll(F.sum, "volume", period)))


def hma(df: DataFrame, period: int = 20, column: str = "close", name: str | None = None, strict: bool = False) -> DataFrame:
    check(df, column)
    check_period(df, period, strict)
    df = weighted(df, {"_half": (column, max(1, period // 2)), "_whole": (column, period)})
    return weighted(df, {name or f"hma_{period}": (2 * F.col("_half") - F.col("_whole"), max(1, int(math.sqrt(period))))}).drop("_half", "_whole")


def ema_mas(df: DataFrame, periods: tuple[int, ...], column: str = "close") -> DataFrame:
    """``ema_n`` for several periods, in the same steps."""
    check(df, column)
    for period in periods:
        check_period(df, period)
    return emas(df, {f"ema_{p}": (column, p) for p in periods})


def volume_ma(df: DataFrame, period: int = 20) -> DataFrame:
    return sma(df, period, "volume", f"volume_ma_{period}")


MOVING = {"sma": sma, "ema": ema_ma, "wma": wma, "dema": dema, "tema": tema, "vwma": vwma, "hma": hma}


def moving_average(df: DataFrame, period: int = 20, kind: str = "sma", column: str = "close", name: str | None = None) -> DataFrame:
    if kind.lower() not in MOVING:
        raise ValueError(f"unknown moving average: {kind}")
    return MOVING[kind.lower()](df, period, column, name)


def moving_averages(df: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 50, 200), kind: str = "sma", column: str = "close") -> DataFrame:
    for period in periods:
        df = moving_average(df, period, kind, column)
    return df


# --------------------------------------------------------------- bands


def bollinger(df: DataFrame, period: int = 20, std_dev: float = 2.0, column: str = "close", ma_type: str = "sma") -> DataFrame:
    check(df, column)
    if period <= 0 or std_dev <= 0:
        raise ValueError("period and std_dev must be positive")
    if ma_type == "ema":
        df = ema(df, column, period, "boll_middle")
    elif ma_type == "sma":
        df = df.withColumn("boll_middle", roll(F.avg, column, period))
    else:
        raise ValueError(f"unknown moving average: {ma_type}")
    df = df.withColumn("_std", roll(F.stddev_samp, column, period))
    df = df.withColumn("boll_upper", F.col("boll_middle") + std_dev * F.col("_std")).withColumn("boll_lower", F.col("boll_middle") - std_dev * F.col("_std"))
    df = df.withColumn("boll_width", F.col("boll_upper") - F.col("boll_lower"))
    return df.withColumn("boll_pct_b", div(F.col(column) - F.col("boll_lower"), "boll_width")).drop("_std")


def bollinger_signals(df: DataFrame, period: int = 20, std_dev: float = 2.0, column: str = "close") -> DataFrame:
    df = bollinger(df, period, std_dev, column)
    x, up, low, mid = F.col(column), F.col("boll_upper"), F.col("boll_lower"), F.col("boll_middle")
    df = df.withColumn("_above", prev(column) > prev("boll_middle")).withColumn("_below", prev(column) < prev("boll_middle"))
    df = df.withColumn("boll_breakout_up", flag(x > up)).withColumn("boll_breakout_down", flag(x < low))
    df = df.withColumn("boll_return_from_up", flag(F.col("_above") & (x <= mid))).withColumn("boll_return_from_down", flag(F.col("_below") & (x >= mid)))
    return df.withColumn("boll_squeeze", flag(F.col("boll_width") < 0.5 * roll(F.avg, "boll_width", 20))).drop("_above", "_below")


def keltner(df: DataFrame, period: int = 20, atr_period: int = 10, multiplier: float = 2.0) -> DataFrame:
    check(df, "high", "low", "close")
    df = emas(df.withColumn("_tr", true_range()), {"kc_middle": ("close", period), "_atr": ("_tr", atr_period)}).drop("_tr")
    df = df.withColumn("kc_upper", F.col("kc_middle") + multiplier * F.col("_atr")).withColumn("kc_lower", F.col("kc_middle") - multiplier * F.col("_atr"))
    return df.withColumn("kc_width", F.col("kc_upper") - F.col("kc_lower")).drop("_atr")


def donchian(df: DataFrame, period: int = 20) -> DataFrame:
    check(df, "high", "low")
    df = df.withColumn("dc_upper", roll(F.max, "high", period)).withColumn("dc_lower", roll(F.min, "low", period))
    return df.withColumn("dc_middle", (F.col("dc_upper") + F.col("dc_lower")) / 2).withColumn("dc_width", F.col("dc_upper") - F.col("dc_lower"))


def compare_bands(df: DataFrame, boll: int = 20, kc: int = 20, dc: int = 20) -> DataFrame:
    return donchian(keltner(bollinger(df, boll), kc), dc)


# --------------------------------------------------------------- trend


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close", adjust: bool = False) -> DataFrame:
    check(df, column)
    if fast >= slow:
        raise ValueError("the fast period must be shorter than the slow one")
    return macd_of(emas(df, {"_fast": (column, fast), "_slow": (column, slow)}, adjust, macd_signal(signal)))


def macd_signal(signal: int = 9) -> dict:
    """The mean of MACD, as a mean that ``emas`` derives from ``_fast`` and ``_slow``."""
    return {"macd_signal": (("_fast", "_slow"), operator.sub, signal)}


def macd_of(df: DataFrame) -> DataFrame:
    """MACD from its means ``_fast``, ``_slow`` and ``macd_signal``."""
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def macd_signals(df: DataFrame, **options) -> DataFrame:
    """Crossings of MACD. The two divergence columns are always false, kept for parity with earlier tables."""
    df = macd(df, **options)
    m, s, h = F.col("macd"), F.col("macd_signal"), F.col("macd_histogram")
    pm, ps, ph = prev("macd"), prev("macd_signal"), prev("macd_histogram")
    out = {
        "macd_golden_cross": (pm <= ps) & (m > s),
        "macd_death_cross": (pm >= ps) & (m < s),
        "macd_zero_cross_up": (pm <= 0) & (m > 0),
        "macd_zero_cross_down": (pm >= 0) & (m < 0),
        "macd_hist_positive": (ph <= 0) & (h > 0),
        "macd_hist_negative": (ph >= 0) & (h < 0),
    }
    df = df.withColumns({k: flag(v) for k, v in out.items()})
    return df.withColumn("macd_bearish_divergence", F.lit(False)).withColumn("macd_bullish_divergence", F.lit(False))


def ppo(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close") -> DataFrame:
    df = emas(df, {"_fast": (column, fast), "_slow": (column, slow)})
    df = df.withColumn("ppo", div(F.col("_fast") - F.col("_slow"), "_slow") * 100).drop("_fast", "_slow")
    df = ema(df, "ppo", signal, "ppo_signal")
    return df.withColumn("ppo_histogram", F.col("ppo") - F.col("ppo_signal"))


def apo(df: DataFrame, fast: int = 12, slow: int = 26, column: str = "close") -> DataFrame:
    df = emas(df, {"_fast": (column, fast), "_slow": (column, slow)})
    return df.withColumn("apo", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")


def adx(df: DataFrame, period: int = 14) -> DataFrame:
    """Average directional index with plain rolling means: ``adx``, ``plus_di``, ``minus_di``."""
    check(df, "high", "low", "close")
    up, down = F.col("high") - prev("high"), prev("low") - F.col("low")
    df = df.withColumn("_up", F.when((up > down) & (up > 0), up).otherwise(0.0)).withColumn("_down", F.when((down > up) & (down > 0), down).otherwise(0.0))
    df = df.withColumn("_tr", true_range()).withColumn("_atr", roll(F.avg, "_tr", period))
    df = df.withColumn("plus_di", 100 * div(roll(F.avg, "_up", period), "_atr")).withColumn("minus_di", 100 * div(roll(F.avg, "_down", period), "_atr"))
    df = df.withColumn("_dx", 100 * div(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return df.withColumn("adx", roll(F.avg, "_dx", period)).drop("_up", "_down", "_tr", "_atr", "_dx")


# ------------------------------------------------------------ momentum


def moves(df: DataFrame, column: str) -> DataFrame:
    """``_gain`` and ``_loss`` against the row before."""
    d = F.col(column) - prev(column)
    return df.withColumn("_gain", F.when(d > 0, d).otherwise(0.0)).withColumn("_loss", F.when(d < 0, -d).otherwise(0.0))


def _strength(gain: str, loss: str) -> Column:
    """100 - 100 / (1 + gain / loss); 100 without losses, null without either."""
    g, l = F.col(gain), F.col(loss)
    return F.when((l == 0) & (g > 0), F.lit(100.0)).otherwise(100.0 - div(F.lit(100.0), 1.0 + div(g, l)))


def rsi(df: DataFrame, period: int = 14, column: str = "close", name: str | None = None) -> DataFrame:
    """Relative strength with span weights, the registered form."""
    check(df, column)
    return rsi_of(emas(moves(df, column), {"_ag": ("_gain", period), "_al": ("_loss", period)}), name or f"rsi_{period}")


def rsi_of(df: DataFrame, name: str) -> DataFrame:
    """Relative strength from the means of gains and losses, ``_ag`` and ``_al``."""
    return df.withColumn(name, _strength("_ag", "_al")).drop("_gain", "_loss", "_ag", "_al")


def rsi_signals(df: DataFrame, period: int = 14, oversold: float = 30, overbought: float = 70, column: str = "close") -> DataFrame:
    r = f"rsi_{period}"
    df = rsi(df, period, column)
    x, p = F.col(r), prev(r)
    df = df.withColumn("_p", p)
    return df.withColumns(
        {"rsi_oversold": flag(x < oversold), "rsi_overbought": flag(x > overbought), "rsi_cross_up_oversold": flag((F.col("_p") < oversold) & (x >= oversold)), "rsi_cross_down_overbought": flag((F.col("_p") > overbought) & (x <= overbought))}
    ).drop("_p")


def rsi_wilder(df: DataFrame, period: int = 14, column: str = "close", strict: bool = False) -> DataFrame:
    """Relative strength with Wilder's weights (1 / n); named ``RSI_n``."""
    check(df, column)
    if strict:
        check_period(df, period, True)
    df = ewms(moves(df, column), {"_ag": ("_gain", 1.0 / period), "_al": ("_loss", 1.0 / period)})
    return df.withColumn(f"RSI_{period}", _strength("_ag", "_al")).drop("_gain", "_loss", "_ag", "_al")


def rsi_class(value: Column) -> Column:
    return F.when(value > 70, "overbought").when(value < 30, "oversold").when(value > 50, "bullish").when(value.isNotNull(), "bearish")


def rsi_divergence(df: DataFrame) -> DataFrame:
    """One row for each series; always neutral, kept for parity (its last centred extreme never exists)."""
    return df.select(*SERIES).distinct().withColumns({"bullish_divergence": F.lit(False), "bearish_divergence": F.lit(False), "divergence": F.lit("neutral")})


def rsi_cutler(df: DataFrame, period: int = 14, column: str = "close") -> DataFrame:
    """Relative strength with plain rolling means; a window without losses gives 0, as its ratio counts as none. Named ``rsi_cutler_n``."""
    check(df, column)
    df = moves(df, column)
    g, l = roll(F.avg, "_gain", period), roll(F.avg, "_loss", period)
    ratio = F.when(l == 0, F.lit(0.0)).otherwise(div(g, l))
    return df.withColumn(f"rsi_cutler_{period}", 100.0 - 100.0 / (1.0 + ratio)).drop("_gain", "_loss")


def stochastic(df: DataFrame, period: int = 14, d: int = 3, smooth_k: int = 3) -> DataFrame:
    check(df, "high", "low", "close")
    df = df.withColumn("_hh", roll(F.max, "high", period)).withColumn("_ll", roll(F.min, "low", period))
    df = df.withColumn("_k", 100 * div(F.col("close") - F.col("_ll"), F.col("_hh") - F.col("_ll")))
    df = df.withColumn("stoch_k", roll(F.avg, "_k", smooth_k) if smooth_k > 1 else F.col("_k"))
    return df.withColumn("stoch_d", roll(F.avg, "stoch_k", d)).drop("_hh", "_ll", "_k")


def stochastic_signals(df: DataFrame, oversold: float = 20, overbought: float = 80, **options) -> DataFrame:
    df = stochastic(df, **options)
    df = df.withColumn("_pk", prev("stoch_k")).withColumn("_pd", prev("stoch_d"))
    k, d, pk, pd = F.col("stoch_k"), F.col("stoch_d"), F.col("_pk"), F.col("_pd")
    golden, death = flag((pk <= pd) & (k > d)), flag((pk >= pd) & (k < d))
    return df.withColumns({"stoch_golden_cross": golden, "stoch_death_cross": death, "stoch_oversold_cross": golden & flag(k < oversold), "stoch_overbought_cross": death & flag(k > overbought)}).drop("_pk", "_pd")


def _mean_deviation(frames: np.ndarray) -> np.ndarray:
    return np.abs(frames - frames.mean(axis=1)[:, None]).mean(axis=1)


def cci(df: DataFrame, period: int = 20, constant: float = 0.015) -> DataFrame:
    check(df, "high", "low", "close")
    df = df.withColumn("_tp", typical()).withColumn("_ma", roll(F.avg, "_tp", period))
    df = framed(df, {"_dev": ("_tp", period, _mean_deviation)})
    return df.withColumn(f"cci_{period}", div(F.col("_tp") - F.col("_ma"), constant * F.col("_dev"))).drop("_tp", "_ma", "_dev")


def williams_r(df: DataFrame, period: int = 14) -> DataFrame:
    check(df, "high", "low", "close")
    hh, ll = roll(F.max, "high", period), roll(F.min, "low", period)
    return df.withColumn(f"williams_r_{period}", -100 * div(hh - F.col("close"), hh - ll))


def roc(df: DataFrame, period: int = 12, column: str = "close") -> DataFrame:
    check(df, column)
    return df.withColumn(f"roc_{period}", 100 * div(F.col(column) - prev(column, period), prev(column, period)))


def mom(df: DataFrame, period: int = 10, column: str = "close") -> DataFrame:
    check(df, column)
    return df.withColumn(f"mom_{period}", F.col(column) - prev(column, period))


def oscillator_report(df: DataFrame, column: str) -> DataFrame:
    """For each series: values, nulls, extreme values (outside three quartile ranges), and whether all are null."""
    q = quantiles(df, column).select("_series", F.col("_q")[0].alias("_q1"), F.col("_q")[1].alias("_q3"))
    x, span = F.col(column), F.col("_q3") - F.col("_q1")
    extreme = (x < F.col("_q1") - 3 * span) | (x > F.col("_q3") + 3 * span)
    g = df.withColumn("_series", F.struct(*SERIES)).join(q, "_series", "left").groupBy("_series")
    g = g.agg(F.count(x).alias("n_values"), F.count_if(x.isNull()).alias("n_null"), F.count_if(extreme).alias("n_extreme"), (F.count(x) == 0).alias("all_null"))
    return g.select("_series.*", "n_values", "n_null", "n_extreme", "all_null")


# ---------------------------------------------------------- volatility


def atr(df: DataFrame, period: int = 14) -> DataFrame:
    check(df, "high", "low", "close")
    df = df.withColumn("tr", true_range())
    return ema(df, "tr", period, f"atr_{period}")


def natr(df: DataFrame, period: int = 14, name: str = "natr") -> DataFrame:
    return atr(df, period).withColumn(f"{name}_{period}", 100 * div(f"atr_{period}", "close"))


def atrp(df: DataFrame, period: int = 14) -> DataFrame:
    return natr(df, period, "atrp").drop("tr", f"atr_{period}")


def standard_deviation(df: DataFrame, period: int = 20, column: str = "close") -> DataFrame:
    check(df, column)
    return df.withColumn(f"std_{period}", roll(F.stddev_samp, column, period))


def historical_volatility(df: DataFrame, period: int = 20, annualize: bool = True, trading_days: int = 252, column: str = "close") -> DataFrame:
    check(df, column)
    df = df.withColumn("_r", F.ln(div(column, prev(column))))
    return df.withColumn(f"hv_{period}", roll(F.stddev_samp, "_r", period) * (math.sqrt(trading_days) if annualize else 1.0) * 100).drop("_r")


def ulcer_index(df: DataFrame, period: int = 14, column: str = "close") -> DataFrame:
    check(df, column)
    top = roll(F.max, column, period)
    df = df.withColumn("_d", F.pow(100 * div(F.col(column) - top, top), 2))
    return df.withColumn(f"ui_{period}", F.sqrt(roll(F.avg, "_d", period))).drop("_d")


def mass_index(df: DataFrame, fast: int = 9, slow: int = 25) -> DataFrame:
    check(df, "high", "low")
    df = emas(df, {"_e1": (F.col("high") - F.col("low"), fast)}, then={"_e2": (("_e1",), same, fast)})
    df = df.withColumn("_ratio", div("_e1", "_e2"))
    return df.withColumn("mass_index", roll(F.sum, "_ratio", slow)).drop("_e1", "_e2", "_ratio")


def choppiness(df: DataFrame, period: int = 14) -> DataFrame:
    if period < 2:
        raise ValueError("the period must be at least 2")
    df = df.withColumn("_tr", true_range())
    span = roll(F.max, "high", period) - roll(F.min, "low", period)
    ratio = div(roll(F.sum, "_tr", period), span)
    return df.withColumn(f"ci_{period}", 100 * F.log10(F.when(ratio > 0, ratio)) / math.log10(period)).drop("_tr")


def atr_simple(df: DataFrame, period: int = 14) -> DataFrame:
    """Rolling mean of the true range, named ``atr_simple_n``."""
    return df.withColumn("_tr", true_range()).withColumn(f"atr_simple_{period}", roll(F.avg, "_tr", period)).drop("_tr")


# -------------------------------------------------------------- volume


def obv(df: DataFrame, column: str = "close") -> DataFrame:
    check(df, column, "volume")
    df = df.withColumn("_s", F.coalesce(F.signum(F.col(column) - prev(column)), F.lit(0.0)) * F.col("volume"))
    return running(df, {"obv": "_s"}).drop("_s")


def vwap(df: DataFrame, period: int | None = None) -> DataFrame:
    check(df, "high", "low", "close", "volume")
    money = typical() * F.col("volume")
    if period:
        return df.withColumn("vwap", div(roll(F.sum, money, period), roll(F.sum, "volume", period)))
    return running(df, {"_money": money, "_traded": "volume"}).withColumn("vwap", div("_money", "_traded")).drop("_money", "_traded")


def mfi(df: DataFrame, period: int = 14) -> DataFrame:
    check(df, "high", "low", "close", "volume")
    df = df.withColumn("_tp", typical())
    df = df.withColumn("_last", prev("_tp"))
    flow = F.col("_tp") * F.col("volume")
    df = df.withColumn("_pos", F.when(F.col("_tp") > F.col("_last"), flow).otherwise(0.0)).withColumn("_neg", F.when(F.col("_tp") < F.col("_last"), flow).otherwise(0.0))
    df = df.withColumn("_p", roll(F.sum, "_pos", period)).withColumn("_n", roll(F.sum, "_neg", period))
    return df.withColumn(f"mfi_{period}", _strength("_p", "_n")).drop("_tp", "_last", "_pos", "_neg", "_p", "_n")


def close_location() -> Column:
    c, h, l = F.col("close"), F.col("high"), F.col("low")
    return F.coalesce(div((c - l) - (h - c), h - l), F.lit(0.0))


def ad(df: DataFrame) -> DataFrame:
    check(df, "high", "low", "close", "volume")
    return running(df, {"ad": close_location() * F.col("volume")})


def cmf(df: DataFrame, period: int = 20) -> DataFrame:
    check(df, "high", "low", "close", "volume")
    return df.withColumn(f"cmf_{period}", div(roll(F.sum, close_location() * F.col("volume"), period), roll(F.sum, "volume", period)))


def emv(df: DataFrame, period: int = 14) -> DataFrame:
    check(df, "high", "low", "volume")
    mid = (F.col("high") + F.col("low")) / 2
    df = df.withColumn("_mid", mid)
    df = df.withColumn("emv", div(F.col("_mid") - prev("_mid"), div("volume", F.col("high") - F.col("low")))).drop("_mid")
    return df.withColumn(f"emv_ma_{period}", roll(F.avg, "emv", period))


def force_index(df: DataFrame, period: int = 13) -> DataFrame:
    check(df, "close", "volume")
    df = df.withColumn("force_index", (F.col("close") - prev("close")) * F.col("volume"))
    return ema(df, "force_index", period, f"force_index_ema_{period}")


def volume_report(df: DataFrame) -> DataFrame:
    """For each series: whether volume is ever negative, the share of zero volume, and whether that is over 10 %."""
    zero = F.avg((F.col("volume") == 0).cast("double"))
    return df.groupBy(*SERIES).agg(F.coalesce(F.bool_or(F.col("volume") < 0), F.lit(False)).alias("has_negative"), F.coalesce(zero, F.lit(0.0)).alias("zero_share"), F.coalesce(zero > 0.1, F.lit(False)).alias("many_zero"))


# ----------------------------------------------------- series utilities


def returns(df: DataFrame, column: str = "close", periods: int = 1, method: str = "simple", name: str | None = None) -> DataFrame:
    """Change against ``periods`` rows before; gaps are filled with the last value first."""
    held = F.last(F.col(column), ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_held", held)
    ratio = div("_held", prev("_held", periods))
    if method not in ("simple", "log"):
        raise ValueError(f"unknown method: {method}")
    out = ratio - 1 if method == "simple" else F.ln(F.when(ratio > 0, ratio))
    return df.withColumn(name or f"{column}_return_{periods}", out).drop("_held")


def _median(frames: np.ndarray) -> np.ndarray:
    return np.median(frames, axis=1)


ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def rolling_stats(df: DataFrame, column: str = "close", window: int = 20, stats: tuple[str, ...] = ("mean", "std", "min", "max", "median", "sum")) -> DataFrame:
    """Unknown statistics are left out."""
    names = {s: f"{column}_rolling_{s}_{window}" for s in stats}
    out = df.withColumns({names[s]: roll(ROLLING[s], column, window) for s in stats if s in ROLLING})
    if "median" in stats:
        out = framed(out, {names["median"]: (column, window, _median)})
    return out.select(*df.columns, *[names[s] for s in stats if s in ROLLING or s == "median"])


def _over(a: str, b: str, up: bool) -> Column:
    return flag(F.col(a) > F.col(b)) if up else flag(F.col(a) < F.col(b))


def crossover(df: DataFrame, a: str, b: str, name: str = "crossover", up: bool = True) -> DataFrame:
    """True where ``a`` is over ``b`` and wasn't in the row before; the first row counts."""
    df = df.withColumn("_over", _over(a, b, up))
    return df.withColumn(name, F.col("_over") & ~F.lag("_over", 1, False).over(series())).drop("_over")


def crossunder(df: DataFrame, a: str, b: str, name: str = "crossunder") -> DataFrame:
    return crossover(df, a, b, name, up=False)


def with_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """``_mean_c`` of each series, from an aggregate that is joined back, so that no task gathers a series."""
    means = df.groupBy(F.struct(*SERIES).alias("_series")).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    return df.withColumn("_series", F.struct(*SERIES)).join(means, "_series").drop("_series")


def peaks(df: DataFrame, column: str = "close", order: int = 3, threshold: float | None = None) -> DataFrame:
    """``is_peak`` and ``is_trough``: strictly beyond up to ``order`` neighbours on both sides; never the first or last row."""
    x = F.col(column)
    before, after = series().rowsBetween(-order, -1), series().rowsBetween(1, order)
    hi = (x > F.max(column).over(before)) & (x > F.max(column).over(after))
    lo = (x < F.min(column).over(before)) & (x < F.min(column).over(after))
    df = df.withColumn("is_peak", flag(hi)).withColumn("is_trough", flag(lo))
    if threshold is not None:
        df, mean = with_means(df, [column]), F.col(f"_mean_{column}")
        df = df.withColumn("is_peak", F.col("is_peak") & (x > mean + threshold)).withColumn("is_trough", F.col("is_trough") & (x < mean - threshold))
        df = df.drop(f"_mean_{column}")
    return df


def _savgol(window: int, at: int) -> list[float]:
    """Weights that give the value at place ``at`` of a parabola fitted to ``window`` equidistant points."""
    m = [sum((i**p) for i in range(window)) for p in range(5)]
    # Solve the 3 x 3 normal equations for the weights of each point by Cramer's rule.
    a = [[float(m[r + c]) for c in range(3)] for r in range(3)]

    def det(x: list[list[float]]) -> float:
        return x[0][0] * (x[1][1] * x[2][2] - x[1][2] * x[2][1]) - x[0][1] * (x[1][0] * x[2][2] - x[1][2] * x[2][0]) + x[0][2] * (x[1][0] * x[2][1] - x[1][1] * x[2][0])

    d, out = det(a), []
    for i in range(window):
        rhs = [1.0, float(i), float(i * i)]
        solved = [det([[rhs[r] if c == k else a[r][c] for c in range(3)] for r in range(3)]) / d for k in range(3)]
        out.append(solved[0] + solved[1] * at + solved[2] * at * at)
    return out


def smooth(df: DataFrame, column: str = "close", method: str = "sma", window: int = 5, name: str | None = None) -> DataFrame:
    """sma, ema (normalised weights) or savgol (parabola, fitted again at both ends) of a column, named ``{column}_smooth``."""
    name = name or f"{column}_smooth"
    if method == "sma":
        return df.withColumn(name, roll(F.avg, column, window))
    if method == "ema":
        return ema(df, column, window, name, adjust=True)
    if method != "savgol" or window % 2 == 0 or window < 3:
        raise ValueError("method must be sma, ema or savgol (with an odd window of 3 or more)")
    half, w = window // 2, series()
    df = df.withColumn("_rn", F.row_number().over(w) - 1)

    def shifted(k: int) -> Column:
        return F.lag(column, -k).over(w) if k < 0 else F.lead(column, k).over(w) if k > 0 else F.col(column)

    def follow(k: int) -> Column:
        """Whether k more rows follow; a series is never counted."""
        return F.lead(F.lit(1), k).over(w).isNotNull() if k else F.lit(True)

    def fitted(at: int) -> Column:
        return sum((c * shifted(i - at) for i, c in enumerate(_savgol(window, at))), F.lit(0.0))

    out = F.when((F.col("_rn") >= half) & follow(half), fitted(half))
    for at in range(half):
        out = out.when((F.col("_rn") == at) & follow(window - 1 - at), fitted(at))
        back = window - 1 - at
        out = out.when((F.col("_rn") >= back) & follow(at) & ~follow(at + 1), fitted(back))
    return df.withColumn(name, out).drop("_rn")


def fill(df: DataFrame, method: str = "ffill", columns: list[str] | None = None) -> DataFrame:
    columns = columns or [c for c, t in df.dtypes if t == "double"]
    if method == "zero":
        return df.fillna(0.0, subset=columns)
    w = series()
    rules = {
        "ffill": lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "bfill": lambda c: F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        "mean": lambda c: F.coalesce(F.col(c), F.col(f"_mean_{c}")),
    }
    if method not in rules:
        raise ValueError(f"unknown method: {method}")
    held = with_means(df, columns) if method == "mean" else df
    return held.withColumns({c: rules[method](c) for c in columns}).select(*df.columns)


def drop_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=columns) if columns else df.dropna()


# Spellings of bar columns in other tables.
COLUMN_NAMES = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume", "Adj Close": "close", "Date": "timestamp", "Timestamp": "timestamp"}


def normalize_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    found = {k: v for k, v in (mapping or COLUMN_NAMES).items() if k in df.columns}
    targets = list(found.values())
    if len(set(targets)) < len(targets) or any(v in df.columns and v not in found for v in targets):
        raise ValueError("two columns would get one name")
    return df.withColumnsRenamed(found)
