"""Bars derived from the given tables, in Spark and in SQL, and small helpers for writing queries in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import bars_from_ticks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars of the event values, one symbol for each event type."""
    return bars_from_ticks(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "value", "1h", exchange="events")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of the order prices, one symbol for each priority."""
    return bars_from_ticks(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderpriority", "o_totalprice", "1d", time="o_orderdate", tie="o_orderkey", exchange="orders")


H = """WITH b AS (SELECT 'events' AS exchange, event_type AS symbol, '1h' AS interval, date_trunc('hour', ts)::TIMESTAMP AS timestamp,
  arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(value) AS volume FROM events GROUP BY event_type, date_trunc('hour', ts))"""
D = """WITH b AS (SELECT 'orders' AS exchange, o_orderpriority AS symbol, '1d' AS interval, date_trunc('day', o_orderdate)::TIMESTAMP AS timestamp,
  arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, sum(o_totalprice) AS volume
  FROM orders GROUP BY o_orderpriority, date_trunc('day', o_orderdate))"""

OVER = "OVER (PARTITION BY symbol ORDER BY timestamp)"


def rows(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sroll(f: str, x: str, n: int) -> str:
    call = f"quantile_cont({x}, 0.5)" if f == "median" else f"{f}({x})"
    return f"(CASE WHEN count({x}) {rows(n)} = {n} THEN {call} {rows(n)} END)"


def slag(x: str, k: int = 1) -> str:
    return f"(lag({x}, {k}) {OVER})"


def sdiv(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def sewm(x: str, alpha: float) -> str:
    a = f"{alpha!r}::DOUBLE"
    return f"list_reduce(list({x}::DOUBLE) FILTER (WHERE {x} IS NOT NULL) {OVER}, lambda y, v: (1 - {a}) * y + {a} * v)"


def sema(x: str, span: int) -> str:
    return sewm(x, 2.0 / (span + 1.0))


def semadj(x: str, span: int) -> str:
    q = 1 - 2.0 / (span + 1.0)
    return f"(list_reduce(list({x}::DOUBLE) FILTER (WHERE {x} IS NOT NULL) {OVER}, lambda y, v: {q!r}::DOUBLE * y + v) * {1 - q!r}::DOUBLE / (1 - pow({q!r}::DOUBLE, count({x}) {OVER})))"


def swma(x: str, n: int) -> str:
    total = " + ".join(f"{n - k} * {slag(x, k) if k else x}" for k in range(n))
    return f"(({total}) / {n * (n + 1) / 2.0}::DOUBLE)"


def layers(*steps: dict[str, str], base: str = H) -> str:
    out, last = base, "b"
    for i, step in enumerate(steps):
        out += f",\nl{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {last})"
        last = f"l{i}"
    return f"{out}\nSELECT {{}} FROM {last}"


def listed(cols: str, digits: int = 6) -> tuple[list[str], list[str]]:
    """Names of columns; those with ``!`` in front are not rounded."""
    exact = [c[1:] for c in cols.split() if c.startswith("!")]
    return exact, [c for c in cols.split() if not c.startswith("!")]


def shown(df: DataFrame, cols: str, keys: tuple[str, ...] = ("symbol", "timestamp"), digits: int = 6) -> DataFrame:
    exact, rounded = listed(cols)
    return df.select(*keys, *exact, *[(F.round(c, digits) + 0.0).alias(c) for c in rounded])


def shown_sql(cols: str, keys: tuple[str, ...] = ("symbol", "timestamp"), digits: int = 6) -> str:
    exact, rounded = listed(cols)
    return ", ".join([*keys, *exact, *[f"round({c}, {digits}) + 0.0 AS {c}" for c in rounded]])


def add(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"two queries are called {name}")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def on_bars(name: str, f: Callable[[DataFrame], DataFrame], steps: list[dict[str, str]], cols: str, digits: int = 6, days: bool = False, tail: str = "", keys: tuple[str, ...] = ("symbol", "timestamp")) -> None:
    """Register an operator over the hourly (or daily) bars with its SQL in layers of columns."""
    source = daily if days else hourly
    add(name, lambda spark, sf: shown(f(source(spark, sf)), cols, keys, digits), layers(*steps, base=D if days else H).format(shown_sql(cols, keys, digits)) + f" {tail}")
