"""One call for what a reader of bars asks: check the keys, decide the source, read the range, add indicators, take the newest rows.

Every call works on all series of the table that the keys choose, so one job serves many symbols.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import SECONDS, SERIES, epoch_ms
from ..functions.registry import from_specs
from . import queries, ranges

# Other spellings of time steps.
ALIASES = {"minute": "1m", "hour": "1h", "hourly": "1h", "day": "1d", "daily": "1d", "week": "1w", "weekly": "1w", "month": "1M", "60m": "1h", "24h": "1d", "7d": "1w"}

Indicators = list[str] | Callable[[DataFrame], DataFrame] | None


def time_step(name: str | None) -> str | None:
    """A known time step from any of its spellings."""
    step = ALIASES.get(name.lower(), name) if name else name
    if step is not None and step not in SECONDS:
        raise ValueError(f"unknown time step: {name}")
    return step


def _chosen(bars: DataFrame, exchange: str | None, symbol: str | None, interval: str | None) -> DataFrame:
    if symbol is not None and "/" in symbol and not all(symbol.split("/")[:2]):
        raise ValueError(f"not a symbol: {symbol}")
    return queries.select_bars(bars, exchange, symbol, time_step(interval))


def _shown(bars: DataFrame, indicators: Indicators) -> DataFrame:
    return bars if not indicators else indicators(bars) if callable(indicators) else from_specs(bars, indicators)


def sources(bars: DataFrame, start: str, end: str, held: DataFrame | None = None, least: float = 0.95, force: str | None = None) -> DataFrame:
    """``source`` (local or fetch) and ``reason`` for the range of each series of ``bars``; ``held``: coverage, if it is catalogued."""
    ask = bars.select(*SERIES).distinct().withColumns({"request_start": epoch_ms(F.lit(start).cast("timestamp_ntz")), "request_end": epoch_ms(F.lit(end).cast("timestamp_ntz"))})
    return ranges.decide_source(ranges.covered(bars) if held is None else held, ask, least, force)


def get(bars: DataFrame, start: str, end: str, exchange: str | None = None, symbol: str | None = None, interval: str | None = None, indicators: Indicators = None, limit: int | None = None, held: DataFrame | None = None, least: float = 0.95, force: str | None = None) -> DataFrame:
    """Bars of a closed range for the series that are held completely enough; ``sources`` names those to be fetched first.

    Indicators are computed over the range; ``limit`` then keeps the newest rows of each series. ``force='local'`` reads what is there.
    """
    df = _chosen(bars, exchange, symbol, interval)
    local = sources(df, start, end, held, least, force).where("source = 'local'").select(*SERIES)
    df = _shown(queries.in_range(df, start, end).join(local, SERIES, "left_semi"), indicators)
    return df if limit is None else queries.newest(df, limit)


def latest(bars: DataFrame, limit: int = 1000, exchange: str | None = None, symbol: str | None = None, interval: str | None = None, indicators: Indicators = None) -> DataFrame:
    """The newest rows of each series, with indicators over these rows."""
    return _shown(queries.newest(_chosen(bars, exchange, symbol, interval), limit), indicators)


def before(bars: DataFrame, time: str, limit: int, exchange: str | None = None, symbol: str | None = None, interval: str | None = None, indicators: Indicators = None) -> DataFrame:
    """The newest closed bars before a time, with indicators over these rows; times are milliseconds."""
    df = queries.closed_before(_chosen(bars, exchange, symbol, interval), time, limit)
    return _shown(df, indicators).withColumn("timestamp", epoch_ms("timestamp"))
