"""Indicators by name: registry, spec strings, chains and presets."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame

from ..core import BLOCK, SERIES, emas, in_blocks, is_blocked, spread, true_range
from ..operators import indicators as I

Indicator = Callable[..., DataFrame]

# The names under which indicators are known.
BUILT_IN: dict[str, Indicator] = {
    "sma": I.sma, "ema": I.ema_ma, "wma": I.wma, "dema": I.dema, "tema": I.tema, "vwma": I.vwma, "hma": I.hma, "boll": I.bollinger, "kc": I.keltner, "dc": I.donchian,
    "macd": I.macd, "ppo": I.ppo, "apo": I.apo, "rsi": I.rsi, "stoch": I.stochastic, "cci": I.cci, "williams_r": I.williams_r, "roc": I.roc, "momentum": I.mom,
    "atr": I.atr, "natr": I.natr, "std": I.standard_deviation, "hv": I.historical_volatility, "ulcer": I.ulcer_index, "mass_index": I.mass_index, "choppiness": I.choppiness,
    "obv": I.obv, "volume_ma": I.volume_ma, "vwap": I.vwap, "mfi": I.mfi, "ad": I.ad, "cmf": I.cmf, "emv": I.emv, "force_index": I.force_index,
}


class Indicators:
    """Registry of indicators; user functions take and return a DataFrame, or a pandas frame of one series."""

    def __init__(self) -> None:
        self._known = dict(BUILT_IN)

    def names(self) -> list[str]:
        return sorted(self._known)

    def register(self, name: str, f: Indicator) -> None:
        self._known[name] = f

    def register_pandas(self, name: str, f: Callable[[pd.DataFrame], pd.DataFrame], added: str, history: int | None = None, size: int = BLOCK) -> None:
        """A function of bars as a pandas frame in time order; ``added`` is the DDL of the columns it adds.

        With ``history`` the function looks back so many rows at most and not
        ahead; it then gets blocks of ``size`` rows with the rows before them,
        so a series of any length takes bounded memory and many tasks. Without,
        a whole series is one group of one task, which suits series of bounded
        length.
        """

        def whole(df: DataFrame) -> DataFrame:
            schema = f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, {added}"
            return df.groupBy(*SERIES).applyInPandas(lambda part: f(part.sort_values("timestamp", kind="stable")), schema)

        def apply(df: DataFrame) -> DataFrame:
            return whole(df) if history is None or is_blocked(df) else in_blocks(df, whole, history, size)

        self._known[name] = apply

    def calculate(self, df: DataFrame, name: str, **params) -> DataFrame:
        if name not in self._known:
            raise ValueError(f"unknown indicator: {name}")
        return self._known[name](df, **params)

    def calculate_many(self, df: DataFrame, wanted: dict[str, dict]) -> DataFrame:
        """All of them in order; one that fails is skipped with a warning."""
        for name, params in wanted.items():
            try:
                df = self.calculate(df, name, **params)
            except ValueError as e:
                warnings.warn(f"{name}: {e}", stacklevel=2)
        return df

    def pipeline(self, steps: list[tuple[str, dict]]) -> Indicator:
        return lambda df: reduce(lambda d, s: self.calculate(d, s[0], **s[1]), steps, df)


def parse_specs(specs: list[str]) -> Iterator[tuple[str, str, dict, str | None]]:
    """(spec, indicator, parameters, column to rename) for texts such as MA_20, EMA_12, RSI_14, BOLL_20, MACD."""
    kinds = {"ma": ("sma", 20), "sma": ("sma", 20), "ema": ("ema", 20), "wma": ("wma", 20), "rsi": ("rsi", 14), "boll": ("boll", 20), "bollinger": ("boll", 20), "macd": ("macd", None)}
    for spec in specs:
        head, _, tail = spec.partition("_")
        if head.lower() not in kinds or (tail and not tail.isdigit()):
            warnings.warn(f"unknown indicator: {spec}", stacklevel=3)
            continue
        name, period = kinds[head.lower()]
        period = int(tail) if tail and period else period
        keeps = name in ("boll", "macd") or (name == "ema" and not tail)
        yield spec, name, {"period": period} if period else {}, None if keeps else f"{name}_{period}"


def from_specs(df: DataFrame, specs: list[str]) -> DataFrame:
    """Columns named by their spec text; bands and MACD keep their own names, and unknown specs are skipped with a warning."""
    for spec, name, params, column in parse_specs(specs):
        df = BUILT_IN[name](df, **params)
        df = df.withColumnRenamed(column, spec) if column else df
    return df


def add_common(df: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 50), volume: bool = True) -> DataFrame:
    """Plain and exponential averages, MACD, RSI, Bollinger bands, ATR, volume average and OBV; all exponential means run in one scan.

    Presets work in blocks where a series is longer than ``core.LONG``.
    """

    def common(df: DataFrame) -> DataFrame:
        for p in periods:
            df = I.sma(df, p)
        df = I.moves(I.bollinger(df, 20), "close").withColumn("tr", true_range())
        df = I.volume_ma(I.obv(df), 20) if volume else df
        close = {f"ema_{p}": p for p in periods} | {"_fast": 12, "_slow": 26}
        df = emas(df, {k: ("close", p) for k, p in close.items()} | {"_ag": ("_gain", 14), "_al": ("_loss", 14), "atr_14": ("tr", 14)}, then=I.macd_signal())
        return I.macd_of(I.rsi_of(df, "rsi_14"))

    return spread(df, common, max(*periods, 20))


def add_trend(df: DataFrame) -> DataFrame:
    return spread(df, lambda b: I.macd_of(emas(b, {f"ema_{p}": ("close", p) for p in (20, 50, 200)} | {"_fast": ("close", 12), "_slow": ("close", 26)}, then=I.macd_signal())), 0)


def add_momentum(df: DataFrame) -> DataFrame:
    """Stochastic, CCI, rate of change and relative strength."""
    return spread(df, lambda b: I.rsi(I.roc(I.cci(I.stochastic(b), 20), 12)), 40)


def add_volatility(df: DataFrame) -> DataFrame:
    return spread(df, lambda b: I.atr(I.standard_deviation(I.bollinger(b))), 20)


def add_volume(df: DataFrame) -> DataFrame:
    return spread(df, lambda b: I.mfi(I.vwap(I.obv(b), 20)), 20)
