"""The catalog of stored bars: partition records of every series, kept as a log of snapshots.

A snapshot is a folder of JSON texts, one document for each exchange and symbol,
and is never changed. ``log`` holds one small file for each version that names
its snapshot; the highest version is the catalog. A writer reads a version,
writes a new snapshot, and publishes it by renaming a file to the next version's
name, which fails where another writer was first; then it starts again from that
writer's version. So readers always see a whole catalog, a writer that dies
between any two steps leaves the old one, and of two writers neither loses
anything. ``vacuum`` removes snapshots that no recent version names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import SERIES
from ..operators import ranges

PARTITION = "interval:string,year:int,month:int,records:long,start_time:timestamp_ntz,end_time:timestamp_ntz"
SCHEMA = f"exchange string, symbol string, partitions array<struct<{PARTITION}>>"
RECORDS = f"exchange string, symbol string, {PARTITION.replace(':', ' ')}"
#: Older records have no interval; they are of this one.
OLD_INTERVAL = "1s"
#: Writers that find another version published start again at most so often.
TRIES = 20


# ------------------------------------------------------------- snapshots


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a maker of its paths."""
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to


def version(spark: SparkSession, path: str) -> int:
    """The newest version; 0 if there is no catalog yet."""
    fs, to = _files(spark, path)
    log = to(f"{path}/log")
    if not fs.exists(log):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(log)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def _snapshot(spark: SparkSession, path: str, number: int) -> str:
    fs, to = _files(spark, path)
    stream = fs.open(to(f"{path}/log/{number:020d}"))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, number: int, name: str) -> bool:
    """Make snapshot ``name`` version ``number``; False if that version is there already."""
    fs, to = _files(spark, path)
    jvm = spark.sparkContext._jvm
    fs.mkdirs(to(f"{path}/log"))
    waiting = to(f"{path}/log/.{name}")
    out = fs.create(waiting, False)
    out.write(bytearray(name.encode()))
    out.close()
    qualified, target = fs.makeQualified(waiting), fs.makeQualified(to(f"{path}/log/{number:020d}"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(qualified, target, options)  # never onto a file that is there
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        fs.delete(waiting, False)
        return False
    return True


def _at(spark: SparkSession, path: str, number: int) -> DataFrame:
    if number == 0:
        return spark.createDataFrame([], RECORDS).select("exchange", "symbol", "interval", "year", "month", "records", "start_time", "end_time")
    df = spark.read.text(f"{path}/snapshots/{_snapshot(spark, path, number)}").select(F.from_json("value", SCHEMA).alias("d")).select("d.exchange", "d.symbol", F.explode("d.partitions").alias("p"))
    return df.select("exchange", "symbol", F.coalesce("p.interval", F.lit(OLD_INTERVAL)).alias("interval"), "p.year", "p.month", "p.records", "p.start_time", "p.end_time")


def change(spark: SparkSession, path: str, f: Callable[[DataFrame], DataFrame]) -> int:
    """Replace the records by ``f`` of them; the new version. ``f`` is asked again when another writer was first."""
    fields = [p.split(":")[0] for p in PARTITION.split(",")]
    for _ in range(TRIES):
        number = version(spark, path)
        doc = f(_at(spark, path, number)).groupBy("exchange", "symbol").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("partitions"))
        name = f"{number + 1}-{uuid.uuid4().hex}"
        doc.select(F.to_json(F.struct("exchange", "symbol", "partitions")).alias("value")).write.text(f"{path}/snapshots/{name}")
        if _publish(spark, path, number + 1, name):
            return number + 1
        fs, to = _files(spark, path)
        fs.delete(to(f"{path}/snapshots/{name}"), True)
    raise RuntimeError(f"other writers were first {TRIES} times")


def vacuum(spark: SparkSession, path: str, keep: int = 10) -> int:
    """Remove snapshots older than the newest ``keep`` versions, and their log files; how many snapshots went.

    Snapshots without a version, which writers that died have left, go too once
    they are older than those that stay.
    """
    fs, to = _files(spark, path)
    newest = version(spark, path)
    first = max(1, newest - max(1, keep) + 1)
    if newest == 0 or not fs.exists(to(f"{path}/snapshots")):
        return 0
    gone = [f.getPath() for f in fs.listStatus(to(f"{path}/snapshots")) if int(f.getPath().getName().split("-")[0]) < first]
    for p in gone:
        fs.delete(p, True)
    for f in fs.listStatus(to(f"{path}/log")):
        if f.getPath().getName().isdigit() and int(f.getPath().getName()) < first:
            fs.delete(f.getPath(), False)
    return len(gone)


# --------------------------------------------------------------- records


def write(records: DataFrame, path: str) -> None:
    """Replace the catalog at ``path`` by records (series keys, year, month, records, start_time, end_time)."""
    change(records.sparkSession, path, lambda _: records)


def read(spark: SparkSession, path: str, exchange: str | None = None, symbol: str | None = None, interval: str | None = None, at: int | None = None) -> DataFrame:
    """Partition records of the catalog (at a version, or the newest), or of the chosen series; none where there is no catalog."""
    df = _at(spark, path, version(spark, path) if at is None else at)
    for name, value in (("exchange", exchange), ("symbol", symbol), ("interval", interval)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Each series with its number of months, its rows, and its first and last time."""
    return read(spark, path).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("months"), F.sum("records").alias("records"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))


def upsert(spark: SparkSession, path: str, records: DataFrame) -> None:
    """Put records in place of those of the same series and month; the first call makes the catalog."""

    def merged(old: DataFrame) -> DataFrame:
        new = records.select(*old.columns).withColumn("updated_at", F.lit(1))
        return ranges.upsert_partitions(old.withColumn("updated_at", F.lit(0)), new).drop("updated_at")

    change(spark, path, merged)


def delete(spark: SparkSession, path: str, exchange: str, symbol: str, interval: str | None = None) -> None:
    """Drop a series, or all intervals of a symbol, from the catalog; stored bars stay."""
    gone = (F.col("exchange") == exchange) & (F.col("symbol") == symbol)
    if interval is not None:
        gone = gone & (F.col("interval") == interval)
    change(spark, path, lambda old: old.where(~gone))
