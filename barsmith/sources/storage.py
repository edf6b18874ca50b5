"""Bars in Parquet, partitioned by series and month.

Writers overwrite whole months (dynamic partition overwrite) from a snapshot
that is written first, so no path is overwritten while a plan reads it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..core import BAR_SCHEMA, OHLCV, SERIES
from ..operators.queries import in_range, newest

KEYS = [*SERIES, "year", "month"]
COMPRESSION = "snappy"
#: Rows of a row group, bytes of a file that compaction aims at, and tasks that it writes with at most.
ROW_GROUP, TARGET_BYTES, MOST_TASKS = 100_000, 128 << 20, 10_000


def with_months(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("timestamp")).withColumn("month", F.month("timestamp"))


def read_bars(spark: SparkSession, root: str) -> DataFrame:
    months = [T.StructField(c, T.IntegerType()) for c in ("year", "month")]
    return spark.read.schema(T.StructType([*BAR_SCHEMA.fields, *months])).parquet(root)


def read_range(spark: SparkSession, root: str, exchange: str, symbol: str, start: str, end: str, interval: str = "1s", columns: list[str] | None = None) -> DataFrame:
    """A closed time range of one series in time order; months outside it are pruned. Empty if there is none."""
    df = read_bars(spark, root).where((F.col("exchange") == exchange) & (F.col("symbol") == symbol) & (F.col("interval") == interval))
    df = in_range(df, start, end).orderBy("timestamp")
    return df.select(*columns) if columns else df.drop("year", "month")


def read_file(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_by_date(spark: SparkSession, root: str, exchange: str, symbol: str, date: str, interval: str) -> DataFrame:
    return read_range(spark, root, exchange, symbol, f"{date} 00:00:00", f"{date} 23:59:59.999999", interval)


def months_held(df: DataFrame) -> DataFrame:
    """First day of each month that a series has."""
    return with_months(df).select(*SERIES, F.make_date("year", "month", F.lit(1)).alias("month_start")).distinct()


def without_summary_rows(df: DataFrame) -> DataFrame:
    """Drop the first row of a month of 1m bars if it looks like a month's total.

    That is, if its volume is over 100 times the mean of the next five rows, or
    its close is over 10 % off theirs. Months of fewer than six rows stay.
    """
    df = with_months(df) if "year" not in df.columns else df
    w = Window.partitionBy(*KEYS).orderBy("timestamp")
    ahead = w.rowsBetween(1, 5)
    df = df.withColumns({"_rn": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(*KEYS)), "_v": F.avg("volume").over(ahead), "_c": F.avg("close").over(ahead)})
    odd = (F.col("volume") > 100 * F.col("_v")) | ((F.col("_c") != 0) & (F.abs(F.col("close") - F.col("_c")) / F.abs(F.col("_c")) > 0.1))
    gone = (F.col("interval") == "1m") & (F.col("_rn") == 1) & (F.col("_n") >= 6) & F.col("_v").isNotNull() & F.col("_c").isNotNull() & F.coalesce(odd, F.lit(False))
    return df.where(~gone).drop("_rn", "_n", "_v", "_c")


def read_legacy(spark: SparkSession, root: str) -> DataFrame:
    """Files under exchange/symbol/interval/YYYY/MM: the keys come from the path."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    path = F.col("_metadata.file_path")
    pattern = r"([^/]+)/([^/]+)/([^/]+)/(\d{4})/(\d{2})/[^/]+$"
    keys = [F.regexp_extract(path, pattern, i + 1).alias(k) for i, k in enumerate(SERIES)]
    return df.select(*keys, *[c for c in df.columns if c not in SERIES])


def write_bars(df: DataFrame, root: str, compression: str = COMPRESSION, mode: str = "overwrite") -> None:
    """Bars of any series, one shuffle by series and month, sorted by time inside files; only months in ``df`` are replaced."""
    rows = with_months(df).select(*[c for c in df.columns if c not in ("year", "month")], "year", "month")
    _write_months(rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "timestamp"), root, compression, mode)


def _write_months(sorted_rows: DataFrame, root: str, compression: str = COMPRESSION, mode: str = "overwrite", rows: int = 0) -> None:
    """Replace the months in ``sorted_rows``; row groups hold ROW_GROUP rows at most, files ``rows`` (0: any number)."""
    writer = sorted_rows.write.option("compression", compression).option("parquet.block.row.count.limit", ROW_GROUP).option("maxRecordsPerFile", rows)
    writer.option("partitionOverwriteMode", "dynamic").mode(mode).partitionBy(*KEYS).parquet(root)


def partition_records(df: DataFrame) -> DataFrame:
    """Records, times and a fingerprint of every month, equal for equal rows in any order."""
    return with_months(df).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("records"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.bit_xor(F.xxhash64("timestamp", *OHLCV)).alias("fingerprint"))


def changed_partitions(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Months that the records of ``catalog`` don't tell of as they are. Both must come from stored bars: sums that are computed again may differ in their last bits."""
    now = partition_records(df).select(*KEYS, F.col("records").alias("_n"), F.col("fingerprint").alias("_f"))
    both = now.join(catalog.select(*KEYS, "records", "fingerprint"), KEYS, "full_outer")
    return both.where(~(F.col("_n").eqNullSafe(F.col("records")) & F.col("_f").eqNullSafe(F.col("fingerprint")))).select(*KEYS)


def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new bars, of equal times the new one."""
    cols = [*SERIES, "timestamp", *OHLCV]
    both = stored.select(*cols).withColumn("_seq", F.lit(0)).unionByName(new.select(*cols).withColumn("_seq", F.lit(1)))
    w = Window.partitionBy(*SERIES, "timestamp").orderBy(F.col("_seq").desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_seq")


def upsert(spark: SparkSession, root: str, new: DataFrame, scratch: str) -> DataFrame:
    """Merge new bars into the months they touch; returns the records of those months."""
    new = with_months(new)
    touched = new.select(*KEYS).distinct()
    try:
        stored = read_bars(spark, root).join(touched, KEYS, "left_semi").drop("year", "month")
        rows = merged(stored, new)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = merged(new, new)
    rows.write.mode("overwrite").parquet(scratch)
    snapshot = spark.read.parquet(scratch)
    write_bars(snapshot, root)
    return partition_records(snapshot)


def without_range(df: DataFrame, start: str, end: str) -> DataFrame:
    t = F.col("timestamp")
    return df.where((t < F.lit(start).cast("timestamp_ntz")) | (t > F.lit(end).cast("timestamp_ntz")))


def deleted_counts(df: DataFrame, start: str, end: str) -> DataFrame:
    """How many rows of each month a deletion of the closed range takes, and how many are left; untouched months don't appear."""
    t = F.col("timestamp")
    hit = (t >= F.lit(start).cast("timestamp_ntz")) & (t <= F.lit(end).cast("timestamp_ntz"))
    g = with_months(df).groupBy(*KEYS).agg(F.count_if(hit).alias("deleted"), F.count_if(~hit).alias("remaining"))
    return g.where("deleted > 0")


def delete_range(spark: SparkSession, root: str, start: str, end: str, scratch: str, condition: str = "true") -> DataFrame:
    """Delete a closed time range of the series that ``condition`` selects; returns the counts of the months it touched."""
    bars = read_bars(spark, root).where(condition)
    counts = deleted_counts(bars.drop("year", "month"), start, end)
    counts.write.mode("overwrite").parquet(f"{scratch}/counts")
    counts = spark.read.parquet(f"{scratch}/counts")
    without_range(bars.join(counts.select(*KEYS), KEYS, "left_semi"), start, end).write.mode("overwrite").parquet(f"{scratch}/rows")
    write_bars(spark.read.parquet(f"{scratch}/rows").drop("year", "month"), root)
    jvm = spark.sparkContext._jvm
    escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in counts.where("remaining = 0").toLocalIterator():  # folders of months that are empty now
        path = jvm.org.apache.hadoop.fs.Path("/".join([root, *[f"{k}={escaped(str(row[k]))}" for k in KEYS]]))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return counts


def file_sizes(spark: SparkSession, root: str, condition: str = "true") -> DataFrame:
    """Series, year, month, path, bytes and rows of each file of the chosen months."""
    files = read_bars(spark, root).where(condition).select(*KEYS, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    return files.groupBy(*KEYS, "path").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def compact(spark: SparkSession, root: str, scratch: str, condition: str = "true", target: int = TARGET_BYTES) -> DataFrame:
    """Merge small files of the chosen months into files of about ``target`` bytes; returns the months that were rewritten.

    A month is rewritten only if its bytes fit into fewer files than it has and
    at least two of them are below three quarters of the target; other months
    aren't read. Its rows are dealt to as many stretches of time as files are
    wanted, each sorted, one task a file. A month is replaced as a whole from a
    snapshot, so a run that breaks off loses nothing.
    """
    files = file_sizes(spark, root, condition)
    months = files.groupBy(*KEYS).agg(F.sum("bytes").alias("_bytes"), F.count(F.lit(1)).alias("files_before"), F.sum("rows").alias("rows_before"), F.count_if(F.col("bytes") < 0.75 * target).alias("_small"))
    months = months.withColumn("files_after", F.ceil(F.col("_bytes") / target)).where("files_after < files_before AND _small >= 2")
    months.select(*KEYS, "files_before", "rows_before", "files_after").write.mode("overwrite").parquet(f"{scratch}/months")
    months = spark.read.parquet(f"{scratch}/months")
    read_bars(spark, root).where(condition).join(months.select(*KEYS), KEYS, "left_semi").write.mode("overwrite").parquet(f"{scratch}/rows")
    rows = spark.read.parquet(f"{scratch}/rows")
    span = rows.groupBy(*KEYS).agg(F.min(F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("_a"), F.max(F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("_z"))
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    held = rows.join(months.select(*KEYS, "files_after"), KEYS).join(span, KEYS).withColumn("_part", F.floor((at - F.col("_a")) / (F.col("_z") - F.col("_a") + 1) * F.col("files_after")))
    total, most = months.agg(F.coalesce(F.sum("files_after"), F.lit(0)), F.max(F.ceil(F.col("rows_before") / F.col("files_after")))).first()
    if total:
        # A task that happens to hold two stretches of a month begins a new file where one would be half as long again.
        dealt = held.repartition(min(total, MOST_TASKS), *KEYS, "_part").sortWithinPartitions(*KEYS, "_part", "timestamp")
        _write_months(dealt.select("timestamp", *OHLCV, *KEYS), root, rows=most + most // 2)
    return months.drop("rows_before")


def latest(df: DataFrame, now: str, limit: int = 1000) -> DataFrame:
    end = F.lit(now).cast("timestamp_ntz")
    return newest(df.where((F.col("timestamp") <= end) & (F.col("timestamp") >= end - F.expr("INTERVAL 30 DAYS"))), limit)


def report_csv(report: DataFrame, path: str) -> None:
    """Quality report as CSV, completeness as a percentage with two digits."""
    report.withColumn("completeness", F.format_string("%.2f%%", F.col("completeness") * 100)).write.option("header", True).mode("overwrite").csv(path)
