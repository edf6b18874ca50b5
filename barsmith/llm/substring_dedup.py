"""Substring deduplication with a log-structured index of window fingerprints.

A window is a run of ``window`` words. Its fingerprint is the smallest hash of
the ``gram``-word runs inside it, so equal windows have equal fingerprints and
neighbouring windows mostly share one: about one fingerprint for every
(window - gram) / 2 words is kept.

The index holds sorted immutable runs, each a bucketed table of fingerprints
with the number of places that had them. A batch is counted, merge-joined with
every run, and written as a new run; a fingerprint that a run or the batch has
had before is marked as repeated. When runs pile up they are merged into one.

What the index marks is only a candidate, verified over the whole corpus by two
independent 64-bit hashes of all words. First each place of a marked fingerprint
stands for the stretch of all windows that it is the smallest gram of: where two
stretches are equal, so are all their windows. Only the windows of stretches
that stay alone, and those of one stretch of each equal set that could meet
them, are then counted one by one. An index that is handed from call to call
also keeps the hashes of all windows of each call: a window of a later call
that stands among them is repeated.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_word_hashes, delete_path, materialize, mix64, new_path, sliced, text_buffers

WINDOW, GRAM = 35, 8
_rng = np.random.Generator(np.random.PCG64(977))
_GRAM_CODE = _rng.integers(0, 1 << 63, size=4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WINDOW_CODES = [_rng.integers(0, 1 << 63, size=4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]


# ------------------------------------------------------------- windows


def _windows(h: np.ndarray, begin: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows that lie in one text, for each the place of its smallest gram (the last of equals), and all gram hashes."""
    n = len(h)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    g = np.zeros(n - gram + 1, dtype=np.uint64)
    for j in range(gram):
        g += h[j : n - gram + 1 + j] * _GRAM_CODE[j]
    g = mix64(g)
    span, low = window - gram + 1, np.arange(len(g))
    size = 1
    while size < span:
        step = min(size, span - size)
        left, right = low[: len(low) - step], low[step:]
        low = np.where(g[right] <= g[left], right, left)
        size += step
    stop = np.repeat(begin[1:], np.diff(begin))
    starts = np.flatnonzero(np.arange(n) + window <= stop)
    return starts, low[starts], g


def _fingerprints(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            key = batch.column(0).to_numpy(zero_copy_only=False)
            h, begin = batch_word_hashes(batch.column(1))
            _, low, g = _windows(h, begin, window, gram)
            place = np.unique(low)
            owner = np.searchsorted(begin, place, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(key[owner]), pa.array(g[place].view(np.int64))], names=["k", "h"])

    return run


def fingerprints(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All window fingerprints of rows (k, text): columns k and h, one row for each place."""
    return keyed.select("k", "text").mapInArrow(_fingerprints(window, gram), "k long, h long")


def _hashes(h: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two independent hashes of the ``size`` words from each place."""
    sums = [np.zeros(len(at), dtype=np.uint64) for _ in _WINDOW_CODES]
    for j in range(int(size.max()) if len(size) else 0):
        on = np.flatnonzero(size > j)
        x = h[at[on] + j]
        for s, code in zip(sums, _WINDOW_CODES, strict=True):
            s[on] += x * code[j]
    return [mix64(s) for s in sums]


def _stretches(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each place of a marked fingerprint: its first window, how many windows, and hashes of the whole stretch."""
        for batch in sliced(batches, 2):
            key = batch.column(1).to_numpy(zero_copy_only=False)
            marked = batch.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            h, begin = batch_word_hashes(batch.column(2))
            starts, low, g = _windows(h, begin, window, gram)
            # Places never fall back from one window to the next, so equal ones stand together.
            place, first, many = np.unique(low, return_index=True, return_counts=True)
            on = np.isin(g[place], marked)
            place, first, many = place[on], starts[first[on]], many[on]
            owner = np.searchsorted(begin, place, side="right") - 1
            lead = (place - first).astype(np.uint64) * np.uint64(131) + many.astype(np.uint64)
            c1, c2 = (mix64(c + mix64(lead)) for c in _hashes(h, first, many + (window - 1)))
            cols = [key[owner], g[place].view(np.int64), (place - begin[owner]).astype(np.int32), (first - begin[owner]).astype(np.int32), many.astype(np.int32), c1.view(np.int64), c2.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k", "h", "place", "start", "many", "c1", "c2"])

    return run


def _single_windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All windows whose smallest gram is at a listed place, with their hashes."""
        for batch in sliced(batches, 2):
            key = batch.column(1).to_numpy(zero_copy_only=False)
            h, begin = batch_word_hashes(batch.column(2))
            lists = batch.column(3)
            listed = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(begin[:-1], pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            starts, low, _ = _windows(h, begin, window, gram)
            at = starts[np.isin(low, listed)] if len(starts) else starts
            owner = np.searchsorted(begin, at, side="right") - 1
            w1, w2 = _hashes(h, at, np.full(len(at), window))
            cols = [key[owner], (at - begin[owner]).astype(np.int32), w1.view(np.int64), w2.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k", "start", "w1", "w2"])

    return run


def _all_windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The fingerprint and both hashes of every window."""
        for batch in sliced(batches, 0):
            h, begin = batch_word_hashes(batch.column(0))
            starts, low, g = _windows(h, begin, window, gram)
            w1, w2 = _hashes(h, starts, np.full(len(starts), window))
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (g[low], w1, w2)], names=["h", "w1", "w2"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            body, offset = text_buffers(batch.column(1))
            lists = batch.column(2)
            spot, empty = np.asarray(lists.offsets), np.asarray(lists.is_null())
            first, many = (lists.values.field(f).to_numpy(zero_copy_only=False) for f in ("start", "many"))
            n_words, n_removed, sha = [], [], []
            for i in range(batch.num_rows):
                w = body[offset[i] : offset[i + 1]].tobytes().split()
                removed = 0
                if not empty[i] and spot[i + 1] > spot[i]:
                    at, n = first[spot[i] : spot[i + 1]], many[spot[i] : spot[i + 1]]
                    edge = np.zeros(len(w) + 1, dtype=np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n + (window - 1), -1)
                    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    removed = len(w) - len(kept)
                    body_out = b" ".join([w[j] for j in kept])
                else:
                    body_out = b" ".join(w)
                n_words.append(len(w))
                n_removed.append(removed)
                sha.append((body_out, hashlib.sha256(body_out).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([x for x, _ in sha], pa.binary()).cast(pa.string()), pa.array([x for _, x in sha])],
                names=["id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return run


# --------------------------------------------------------------- index


class WindowIndex:
    """Runs of window fingerprints, kept as bucketed, sorted tables in the folder that driver and executors share.

    ``fan`` runs are merged into one. Runs are never changed once written.
    ``windows`` are tables of window hashes, one for each call of
    ``remove_repeats`` that was handed the index; ``add`` alone leaves none.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 32, fan: int = 3):
        self.spark, self.buckets, self.fan = spark, buckets, fan
        self.name = name or f"windows_{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.paths: dict[str, str] = {}
        self.windows: list[str] = []
        self.shape: tuple[int, int] | None = None
        self._made = 0

    def add(self, fingerprints_: DataFrame) -> str:
        """Count a batch of fingerprints (column h), merge-join it with each run and write it as a new run.

        The run's rows are h, n (places in the batch) and repeated: true if the
        batch or any earlier run brings the places to two.
        """
        batch = fingerprints_.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        seen = [self.spark.table(r).select("h", F.lit(True).alias(f"seen{i}")) for i, r in enumerate(self.runs)]
        joined = reduce(lambda d, s: d.join(s.hint("merge"), "h", "left"), seen, batch)
        known = [F.coalesce(F.col(f"seen{i}"), F.lit(False)) for i in range(len(seen))]
        repeated = reduce(lambda a, b: a | b, known, F.col("n") > 1)
        name = self._write(joined.select("h", "n", repeated.alias("repeated")))
        if len(self.runs) >= self.fan:
            self.compact()
        return name

    def compact(self) -> None:
        """Merge all runs into one; the old ones are dropped when the new one is written."""
        if len(self.runs) < 2:
            return
        old, self.runs = self.runs, []
        self._write(self._merged(old))
        self._drop(old)

    def drop(self) -> None:
        """Delete the index."""
        self._drop(self.runs + self.windows)
        self.runs, self.windows = [], []

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            delete_path(self.spark, self.paths.pop(name))

    def keep_windows(self, texts: DataFrame, window: int, gram: int) -> None:
        """Write the hashes of all windows of a batch (column text) for later calls."""
        rows = texts.select("text").mapInArrow(_all_windows(window, gram), "h long, w1 long, w2 long").distinct()
        name = f"{self.name}_windows{len(self.windows)}"
        self._save(rows, name)
        self.windows.append(name)

    def repeated(self) -> DataFrame:
        """Fingerprints (h) that more than one place has had."""
        return self._merged(self.runs).where("repeated").select("h")

    def _merged(self, names: list[str]) -> DataFrame:
        """One row for each fingerprint of several runs: full merge joins, bucket by bucket, without a shuffle."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select("h", F.col("n").alias("_n"), F.col("repeated").alias("_r"))
            n = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
            marked = F.coalesce("repeated", F.lit(False)) | F.coalesce("_r", F.lit(False)) | (n > 1)
            return a.join(b.hint("merge"), "h", "full").select("h", n.alias("n"), marked.alias("repeated"))

        return reduce(two, [self.spark.table(r) for r in names])

    def _write(self, rows: DataFrame) -> str:
        name, self._made = f"{self.name}_run{self._made}", self._made + 1
        self._save(rows, name)
        self.runs.append(name)
        return name

    def _save(self, rows: DataFrame, name: str) -> None:
        self.paths[name] = new_path(self.spark, name)
        rows.repartition(self.buckets, "h").write.format("parquet").option("path", self.paths[name]).bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, gram: int = GRAM, batches: int = 2, index: WindowIndex | None = None) -> DataFrame:
    """Remove every word that a repeated window covers: id, n_words, n_removed, kept (words joined by a space), kept_sha256.

    A window is repeated if its words, in order, also start at any other place
    of the corpus, the same text included. One row per input row. Null and
    empty texts have no words; texts shorter than a window keep all. Repeated
    rows count as other places, so a row that stands twice loses every window.
    An empty table gives no rows. Very long texts are read whole, in slices. Ids
    keep their type; other columns are not read. The corpus enters the index in ``batches``
    steps, each merge-joined with what came before; the result doesn't depend on
    their number. With an ``index`` from earlier calls, windows of the texts of
    those calls are other places too; what those calls returned stays as it was.
    All calls of an index must have the same ``window`` and ``gram``.
    """
    if window > len(_WINDOW_CODES[0]) or not 0 < gram <= window:
        raise ValueError("0 < gram <= window <= 4096 must hold")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("k", F.xxhash64("id", "text"))
    lasting, index = index is not None, index or WindowIndex(spark)
    if index.shape not in (None, (window, gram)):
        raise ValueError("the index was made with another window or gram")
    index.shape = (window, gram)
    history = [spark.table(name) for name in index.windows]
    for b in range(batches):
        index.add(fingerprints(keyed.where(F.pmod("k", F.lit(batches)) == b), window, gram))
    index.compact()

    # As a plain table, so that Spark may split the partition of a fingerprint that very many texts have.
    repeated = materialize(index.repeated(), "repeated")
    if lasting:
        index.keep_windows(keyed, window, gram)
    else:
        index.drop()
    marks = fingerprints(keyed, window, gram).join(repeated, "h", "left_semi")
    met = marks.select("h").distinct()
    marks = marks.groupBy("k").agg(F.collect_set("h").alias("marks"))
    # All three joins of texts read one shuffle by k.
    rows = keyed.select("id", "k", "text")
    near = rows.join(marks.hint("shuffle_hash"), "k").select("id", "k", "text", "marks")
    # Written, as it is read three times. Sets too: beside plain tables Spark may split a set that very many places share.
    stretches = materialize(near.mapInArrow(_stretches(window, gram), "k long, h long, place int, start int, many int, c1 long, c2 long"), "stretches")
    sets = stretches.groupBy("h", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "place")).alias("one"))
    sets = materialize(sets, "sets")
    alone, equal = sets.where("n = 1"), sets.where("n > 1")
    whole = stretches.join(equal.select("h", "c1", "c2"), ["h", "c1", "c2"], "left_semi").select("k", "start", "many")

    singles = alone.unionByName(equal.join(alone.select("h").distinct(), "h", "left_semi").select(*alone.columns))
    places = singles.groupBy(F.col("one.k").alias("k")).agg(F.collect_set("one.place").alias("places"))
    open_ = rows.join(places.hint("shuffle_hash"), "k").select("id", "k", "text", "places")
    windows = materialize(open_.mapInArrow(_single_windows(window, gram), "k long, start int, w1 long, w2 long"), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    # Stretches that are equal to none here are alone, so all their windows are among those that meet the history.
    for old in history:
        twice = twice.union(old.join(met, "h", "left_semi").select("w1", "w2")).distinct()
    hits = windows.join(materialize(twice, "twice"), ["w1", "w2"], "left_semi").select("k", "start", F.lit(1).alias("many"))

    gone = whole.unionByName(hits).groupBy("k").agg(F.collect_set(F.struct("start", "many")).alias("gone"))
    marked = rows.join(gone.hint("shuffle_hash"), "k", "left").select("id", "text", "gone")
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    out = marked.mapInArrow(_cut(window), f"id {id_type}, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


#: DuckDB SQL for the digest of the whole operator over a relation of columns doc_id, text; for small tables.
ORACLE = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents),
windows AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM texts WHERE len(w) >= 35)),
twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM windows WHERE s IN (SELECT s FROM twice))),
cut AS (SELECT r, list(j) AS js FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN js IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(js, x[2])), lambda x: x[1]), ' ') END) AS kept_sha256
FROM texts LEFT JOIN cut USING (r)
"""
