"""Coverage of series: closed ranges of milliseconds, merged, subtracted and compared for all series at once.

Range tables have the series keys and ``start`` and ``end`` (both included).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import SERIES, epoch_ms, step_seconds, written


def step_ms(column: str = "interval") -> Column:
    return step_seconds(column) * 1000


#: Milliseconds of the bins into which starts of ranges are dealt.
BIN = 86_400_000


def _key(start: str, bin_ms: int) -> Column:
    """Series and time bin, by which rows are dealt, so that a long series is spread over many tasks."""
    return F.struct(*SERIES, F.expr(f"`{start}` div {bin_ms}").alias("_bin"))


#: Series of a key.
_OF = [f"_key.{c}" for c in SERIES]


def merge(ranges: DataFrame, step: int | None = None, bin_ms: int = BIN) -> DataFrame:
    """Ranges that touch or overlap, or lie at most a step apart, become one.

    Ranges are merged inside the bins in which they start; a table of one row
    for each bin tells the furthest end of all bins before, and which range of an
    earlier bin the first ones of a bin go on with.
    """
    return _islands(ranges, step, bin_ms).drop("rows")


def _islands(ranges: DataFrame, step: int | None, bin_ms: int) -> DataFrame:
    """Merged ranges, and of how many rows each is made."""
    reach = F.lit(step) if step is not None else step_ms()
    held = ranges.select(_key("start", bin_ms).alias("_key"), "start", "end", reach.alias("_reach"))
    bins = Window.partitionBy(*_OF).orderBy("_key._bin")
    earlier = bins.rowsBetween(Window.unboundedPreceding, -1)
    far = held.groupBy("_key").agg(F.max("end").alias("_far"))
    held = held.join(far.select("_key", F.max("_far").over(earlier).alias("_far")), "_key")
    w = Window.partitionBy("_key").orderBy("start", "end")
    top = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_far"))
    held = held.withColumn("_new", F.coalesce(F.col("start") > top + F.col("_reach"), F.lit(True)).cast("int"))
    held = held.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Island 0 of a bin goes on from the last island that began in an earlier bin.
    local = held.groupBy("_key", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("rows"))
    tails = local.groupBy("_key").agg(F.sum(F.when(F.col("_island") == 0, F.col("rows"))).alias("_more"), F.max(F.when(F.col("_island") == 0, F.col("end"))).alias("_tail"), F.max(F.when(F.col("_island") > 0, F.col("start"))).alias("_last"))
    tails = tails.withColumn("_root", F.last("_last", ignorenulls=True).over(earlier)).where(F.col("_tail").isNotNull())
    tails = tails.select(*[F.col(c).alias(c.split(".")[1]) for c in _OF], "_root", "_tail", "_more").groupBy(*SERIES, "_root").agg(F.max("_tail").alias("_tail"), F.sum("_more").alias("_more"))
    tails = tails.select(_key("_root", bin_ms).alias("_key"), F.col("_root").alias("start"), "_tail", "_more")
    out = local.where("_island > 0").join(tails, ["_key", "start"], "left")
    return out.select(*_OF, "start", F.greatest("end", "_tail").alias("end"), (F.col("rows") + F.coalesce("_more", F.lit(0))).alias("rows"))


def completeness(ranges: DataFrame, step: int | None = None) -> DataFrame:
    reach = F.lit(step) if step is not None else step_ms()
    g = merge(ranges, step).withColumn("_step", reach).groupBy(*SERIES).agg(F.sum(F.col("end") - F.col("start") + F.col("_step")).alias("_held"), (F.max("end") - F.min("start") + F.max("_step")).alias("_span"))
    return g.select(*SERIES, F.least(F.lit(1.0), F.col("_held") / F.col("_span")).alias("completeness"))


def add(ranges: DataFrame, more: DataFrame, step: int | None = None) -> DataFrame:
    return merge(ranges.select(*SERIES, "start", "end").unionByName(more.select(*SERIES, "start", "end")), step)


#: Ranges of a series that meet requests as one chunk.
CHUNK = 1 << 10
_MAX = (1 << 63) - 1


def missing(held: DataFrame, requests: DataFrame, bin_ms: int = BIN) -> DataFrame:
    """Parts of requests (series keys, request_start, request_end) that no held range covers; edges one millisecond off.

    Merged ranges are numbered by start, and both ends of a request learn how
    many ranges start up to them, all in time bins with a table of one row for
    each bin. So a request knows the numbers of the ranges after which it may
    miss something, and meets chunks of just these: the work grows with what is
    found, not with the length of a request, and no task sees a series.
    """
    pieces = written(merge(held, 1, bin_ms), "ranges")
    asked = requests.select(*SERIES, F.col("request_start").cast("long").alias("_a"), F.col("request_end").cast("long").alias("_z")).where("_a <= _z").distinct()
    none = F.lit(None).cast("long")
    ends = asked.select("*", F.explode(F.array("_a", "_z")).alias("_t"))
    rows = pieces.select(_key("start", bin_ms).alias("_key"), F.col("start").alias("_t"), F.lit(1).alias("_one"), F.col("end").alias("_end"), none.alias("_a"), none.alias("_z"))
    rows = rows.unionByName(ends.select(_key("_t", bin_ms).alias("_key"), "_t", F.lit(0).alias("_one"), none.alias("_end"), "_a", "_z"))
    bins = rows.groupBy("_key").agg(F.sum("_one").alias("_n"), F.min(F.when(F.col("_one") == 1, F.col("_t"))).alias("_low"))
    series_ = Window.partitionBy(*_OF)
    before = F.sum("_n").over(series_.orderBy("_key._bin").rowsBetween(Window.unboundedPreceding, -1))
    later = F.min("_low").over(series_.orderBy(F.desc("_key._bin")).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(bins.select("_key", F.coalesce(before, F.lit(0)).alias("_before"), later.alias("_later")), "_key")
    # At equal times ranges come first, so that they count as started.
    order = "OVER (PARTITION BY _key ORDER BY _t, _one DESC"
    rows = rows.selectExpr("*", f"_before + sum(_one) {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _number", f"coalesce(lead(if(_one = 1, _t, NULL), 1) IGNORE NULLS {order}), _later) AS _next")
    gaps = rows.where("_one = 1").select(*_OF, "_number", (F.col("_end") + 1).alias("_g0"), F.coalesce(F.col("_next") - 1, F.lit(_MAX)).alias("_g1")).where("_g0 <= _g1")
    asks = rows.where("_one = 0").select(*_OF, "_a", "_z", "_t", "_number", "_next").groupBy(*SERIES, "_a", "_z").agg(
        F.min("_number").alias("_lo"), F.max("_number").alias("_hi"), F.min_by("_next", "_t").alias("_first")
    )
    parts = [F.col("_a").alias("request_start"), F.col("_z").alias("request_end")]
    head = asks.where("_lo = 0").select(*SERIES, *parts, F.col("_a").alias("missing_start"), F.least(F.col("_z"), F.coalesce(F.col("_first") - 1, F.col("_z"))).alias("missing_end"))
    chunks = F.sequence(F.expr(f"greatest(_lo, 1) div {CHUNK}"), F.expr(f"_hi div {CHUNK}"))
    asks = asks.where("_hi >= 1").withColumn("_chunk", F.explode(chunks))
    found = asks.join(gaps.withColumn("_chunk", F.expr(f"_number div {CHUNK}")), [*SERIES, "_chunk"]).where("_number BETWEEN _lo AND _hi")
    found = found.select(*SERIES, *parts, F.greatest("_a", "_g0").alias("missing_start"), F.least("_z", "_g1").alias("missing_end"))
    return head.unionByName(found).where("missing_start <= missing_end")


def cut(ranges: DataFrame, start: int, end: int) -> DataFrame:
    """What is left of each range when [start, end] is taken out; empty rests go."""
    s, e = F.col("start"), F.col("end")
    apart = (e < start) | (s > end)
    left = F.struct(s.alias("start"), F.least(e, F.lit(start - 1)).alias("end"))
    right = F.struct(F.greatest(s, F.lit(end + 1)).alias("start"), e.alias("end"))
    both = F.when(apart, F.array(F.struct(s.alias("start"), e.alias("end")))).otherwise(F.array(left, right))
    out = ranges.select(*SERIES, F.explode(both).alias("_r")).select(*SERIES, F.col("_r.start").alias("start"), F.col("_r.end").alias("end"))
    return out.where("start <= end")


def extent(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy(*SERIES).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def upsert_partitions(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """Partition records with the latest ``updated_at`` for each series, year and month; new ones win ties."""
    both = catalog.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*SERIES, "year", "month").orderBy(F.col("updated_at").desc(), F.col("_new").desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def covered(bars: DataFrame, bin_ms: int = BIN) -> DataFrame:
    """True islands of the stored bars, with their rows: runs of rows not further apart than a step, found like ``merge``."""
    at = epoch_ms("timestamp")
    return _islands(bars.select(*SERIES, at.alias("start"), at.alias("end")), None, bin_ms)


def decide_source(held: DataFrame, requests: DataFrame, least: float = 0.95, force: str | None = None) -> DataFrame:
    """``source`` (local or fetch) and ``reason`` of every request, from the coverage of its series."""
    span = extent(held).join(completeness(held), SERIES)
    df = requests.join(span, SERIES, "left")
    reason = (
        F.when(F.col("start").isNull(), "no_data").when(F.col("start") > F.col("request_start"), "starts_late").when(F.col("end") < F.col("request_end"), "ends_early").when(F.col("completeness") < least, "incomplete").otherwise("covered")
    )
    if force is not None:
        return df.withColumn("source", F.lit(force)).withColumn("reason", F.lit("forced"))
    return df.withColumn("reason", reason).withColumn("source", F.when(F.col("reason") == "covered", "local").otherwise("fetch"))


def explain_source(decided: DataFrame) -> DataFrame:
    return decided.withColumn("explanation", F.format_string("%s %s: %s (%s)", "symbol", "interval", "source", "reason"))


def nested(ranges: DataFrame) -> DataFrame:
    """One row for each exchange and symbol with a map from interval to its sorted ranges."""
    each = ranges.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    return each.groupBy("exchange", "symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("interval", "ranges")))).alias("intervals"))
