"""Helpers shared by the corpus operators: shared storage, words, ranks, graphs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where a session on one machine leaves it unset (tests) a folder of our
    own is chosen and set; on a cluster such a folder would be lost with its
    machine, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="barsmith-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the task it ran.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder by Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """128 bits (md5) that name a row by the values of columns; null differs from every value."""
    parts = []
    for name in columns:
        text = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# ------------------------------------------------------------------ words


def words(text: Column) -> Column:
    """Array of the words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, modulus: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part``; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus) == part


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(n, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of every word of a UTF-8 text (bytes as uint8), in order.

    Works slice by slice, cut at separators, so that memory stays bounded for
    any length of text; one word longer than a slice is taken whole.
    """
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + _SLICE)
        if end < n:
            gaps = np.flatnonzero(_SEPARATOR[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(_SEPARATOR[data[end:]])
                end = end + int(rest[0]) if len(rest) else n
        out.append(_slice_hashes(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _slice_hashes(data: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SEPARATOR[data]
    edge = np.diff(inside)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
    raw = (total[stop] - total[start]) * down[start]
    return mix64(raw + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offset = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return body, offset


def sliced(batches: Iterator[pa.RecordBatch], text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts (column number ``text``) have ``limit`` bytes at most, or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(size, dtype=np.int64), 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def batch_word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts of a column, and where each text's words begin (n + 1)."""
    body, offset = text_buffers(column)
    parts, counts, i, n = [], [], 0, len(offset) - 1
    while i < n:
        # Several short texts are hashed at once: a separator is put between them.
        j = int(np.searchsorted(offset, offset[i] + _SLICE // 2, side="right")) - 1
        j = min(max(j, i + 1), n)
        if j - i == 1:
            h = word_hashes(body[offset[i] : offset[j]])
            parts.append(h)
            counts.append(np.array([len(h)]))
        else:
            size = int(offset[j] - offset[i])
            shift = np.arange(j - i + 1)
            begin = (offset[i : j + 1] - offset[i]) + shift
            joined = np.full(size + (j - i), 0x20, dtype=np.uint8)
            keep = np.ones(len(joined), dtype=bool)
            keep[begin[1:] - 1] = False
            joined[keep] = body[offset[i] : offset[j]]
            parts.append(_slice_hashes(joined))
            first = ~_SEPARATOR[joined]
            first[1:] &= _SEPARATOR[joined[:-1]]
            upto = np.concatenate(([0], np.cumsum(first)))
            counts.append(np.diff(upto[begin]))
        i = j
    total = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, dtype=np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)), total.astype(np.int64)


# ------------------------------------------------------------------ ranks


def with_global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Number the rows 0, 1, 2 ... by ``order``, a total order, without one task seeing them all.

    Rows are dealt by range and sorted within partitions; a table with one row
    for each partition carries the offsets. Pass narrow rows: they are written
    once to the shared folder.
    """
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.select("*", F.spark_partition_id().alias("_part"), low.alias("_at")), "rank")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each shuffle partition, so its size is bounded by that setting.
    offsets = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    return dealt.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


# ------------------------------------------------------------------ graphs


def connected_components(edges: DataFrame, limit: int = 200) -> DataFrame:
    """Smallest node that each node of an undirected graph reaches: columns ``node``, ``root``.

    Alternates large-star and small-star steps (Kiveris et al., 2014): joins
    and minimum aggregates only, a number of rounds that grows with the
    logarithm of the graph, each round written to the shared folder.
    ``edges`` has columns ``a`` and ``b``; nodes without an edge don't appear.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = _settled(now)
    for _ in range(limit):
        if mark[0] == 0:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        before, (now, mark) = mark, _settled(small.where("a <> b").distinct())
        if mark == before:
            break
    else:
        raise RuntimeError("the components didn't settle")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    kept = materialize(edges, "edges")
    sums = [F.sum(F.xxhash64("a", "b", F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF))) for k in (1, 2)]
    row = kept.agg(F.count(F.lit(1)), *sums).first()
    return kept, tuple(row)


# ------------------------------------------------------- groups in a stream


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first ``keys`` (numeric) columns, cut so that no group crosses a border."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(held[0]):
            continue
        last = np.ones(len(held[0]), dtype=bool)
        for c in held[:keys]:
            last &= c == c[-1]
        cut = int(np.argmax(last))
        if cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield held


def group_bounds(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal rows."""
    change = np.zeros(len(cols[0]), dtype=bool)
    change[0] = True
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(change)
    return start, np.append(start[1:], len(change))


# ----------------------------------------------------------------- vectors


def finite_vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``id`` and ``v``, the vectors without null, infinite or undefined components, in doubles."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    rows = df.where(v.isNotNull()).where(F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(f"`{id_column}`").alias("id"), F.transform(v, lambda c: c.cast("double")).alias("v"))


def whole_vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``id`` and ``x``: floor(256 * component) as whole numbers, for vectors without null, infinite or undefined components.

    Components beyond 64 bits count as the nearest whole number of 64 bits.
    """
    return finite_vectors(df, id_column, vector).select("id", F.transform("v", lambda c: F.floor(c * 256).cast("long")).alias("x"))


def whole_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of int64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(n, -1) if n else np.empty((0, 0), dtype=np.int64)
