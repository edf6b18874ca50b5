"""Benchmark decontamination by greedy string tiling.

Runs of ``min_match`` words that a document and a benchmark item share are the
seeds, found by a join on rolling (Karp-Rabin) hashes. Seeds that continue each
other on one diagonal make up a maximal match. For each pair of document and
item the longest match that is still free is marked again and again, no word of
either side twice, until none of ``min_match`` words is left. The share of the
item's words that is marked, its coverage, is large even if its sentences were
put in another order, since tiles may come in any order. For an item of fewer
words all its words are one seed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_word_hashes, fresh, group_bounds, materialize, mix64, sliced

MIN_MATCH = 5
COVERAGE = 0.8
#: A benchmark of up to so many words is broadcast (32 bytes a word); a larger one is joined by shuffles.
BROADCAST_WORDS = 1_000_000
#: Matching seeds that are in memory at once.
MATCHES = 1_000_000
_CODE = np.random.Generator(np.random.PCG64(4711)).integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def normal(text: Column) -> Column:
    """Lower case; everything but letters and digits becomes a space. Null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")


def _runs(h: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``width`` words inside one text, and their hashes."""
    if len(h) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for j in range(width):
        g += h[j : len(h) - width + 1 + j] * _CODE[j]
    stop = np.repeat(begin[1:], np.diff(begin))
    at = np.flatnonzero(np.arange(len(h)) + width <= stop)
    return at, mix64(g[at] + np.uint64(width))


class Seeds:
    """All seeds of some items, sorted by hash, for each width that items have: ``width``, or the words of a shorter item."""

    def __init__(self, texts: pa.Array, width: int):
        h, begin = batch_word_hashes(texts)
        self.size = np.diff(begin)
        self.tables = []
        for w in range(1, width + 1):
            at, g = _runs(h, begin, w)
            owner = np.searchsorted(begin, at, side="right") - 1
            on = self.size[owner] == w if w < width else self.size[owner] >= w
            if on.any():
                order = np.argsort(g[on], kind="stable")
                self.tables.append((w, g[on][order], owner[on][order], (at - begin[owner])[on][order]))

    def segments(self, h: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each width: maximal matches with texts as rows (text, item, diagonal, first and last place of a seed in the text).

        Repeated words make every place of a text match every place of an item;
        at most MATCHES of them are in memory, as matches on one diagonal become one.
        """
        for width, hashes, items, places in self.tables:
            at, g = _runs(h, begin, width)
            first, past = np.searchsorted(hashes, g, side="left"), np.searchsorted(hashes, g, side="right")
            hit = np.flatnonzero(past > first)
            many = np.cumsum((past - first)[hit])
            found, i = [np.empty((0, 5), dtype=np.int64)], 0
            while i < len(hit):
                j = max(i + 1, int(np.searchsorted(many, (many[i - 1] if i else 0) + MATCHES, side="right")))
                part = hit[i:j]
                n = (past - first)[part]
                spot = np.repeat(first[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                pos = np.repeat(at[part], n)
                owner = np.searchsorted(begin, pos, side="right") - 1
                pos = pos - begin[owner]
                found.append(_joined(np.column_stack([owner, items[spot], pos - places[spot], pos, pos])))
                i = j
            yield width, _joined(np.concatenate(found)) if len(found) > 2 else found[-1]


def _joined(rows: np.ndarray) -> np.ndarray:
    """Matches (text, item, diagonal, first, last) with those that continue each other made one, in that order."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return rows
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1) | (rows[1:, 3] > rows[:-1, 4] + 1)
    start = np.flatnonzero(new)
    out = rows[start]
    out[:, 4] = np.maximum.reduceat(rows[:, 4], start)
    return out


def tiles(matches: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in the document, start in the item, words) from the maximal matches (diagonal, first, last) of one pair."""
    diagonal, first, last = matches.T
    heap = [(-int(z - a + width), int(a - d), int(a)) for d, a, z in zip(diagonal, first, last, strict=True)]
    heapq.heapify(heap)
    base = int(first.min())
    doc, item = np.zeros(int(last.max()) - base + width, dtype=bool), np.zeros(int((last - diagonal).max()) + width, dtype=bool)
    out = []
    while heap:
        size, p, a = heapq.heappop(heap)
        size = -size
        taken = doc[a - base : a - base + size] | item[p : p + size]
        if not taken.any():
            doc[a - base : a - base + size] = item[p : p + size] = True
            out.append((a, p, size))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([1], taken.astype(np.int8), [1]))))
        for i, j in zip(edge[::2], edge[1::2], strict=True):
            if j - i >= width:
                heapq.heappush(heap, (-int(j - i), p + int(i), a + int(i)))
    return out


def greedy_tiles(at: np.ndarray, place: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Tiles from all shared runs of ``width`` words of one pair."""
    none = np.zeros(len(at), dtype=np.int64)
    return tiles(_joined(np.column_stack([none, none, at - place, at, at]))[:, 2:], width)


def _covered(seeds: Seeds, texts: pa.Array) -> list[tuple[int, int, int, float]]:
    """(text, item, tiles, coverage) of all pairs with a seed in common."""
    h, begin = batch_word_hashes(texts)
    out = []
    for width, rows in seeds.segments(h, begin):
        if len(rows):
            for i, j in zip(*group_bounds([rows[:, 0], rows[:, 1]]), strict=True):
                found = tiles(rows[i:j, 2:], width)
                out.append((int(rows[i, 0]), int(rows[i, 1]), len(found), sum(t[2] for t in found) / int(seeds.size[rows[i, 1]])))
    return out


_FOUND = "k1 long, k2 long, item long, n_tiles long, coverage double"


def _rows(k1: pa.Array, k2: pa.Array, item: np.ndarray, n: list[int], coverage: list[float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([k1, k2, pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(coverage, pa.float64())], names=["k1", "k2", "item", "n_tiles", "coverage"])


def _probe(shared):
    """Coverage of the items of a broadcast benchmark by documents (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seeds = shared.value
        for batch in sliced(batches, 2):
            found = _covered(seeds, batch.column(2))
            at = pa.array([f[0] for f in found], pa.int64())
            yield _rows(batch.column(0).take(at), batch.column(1).take(at), names[[f[1] for f in found]], [f[2] for f in found], [f[3] for f in found])

    return run


#: Bits of the filter that keeps seeds of no item from being shuffled: 16 MB, whatever the size of the benchmark.
FILTER_BITS, _PART_BITS = 1 << 27, 1 << 15


def _seed_hashes(widths: list[int], width: int, bits=None):
    """Different seeds of texts (key columns, text): (h, key columns).

    Items (one key) have those of their own width. Documents have those of all
    ``widths`` that items have, as far as the filter ``bits`` lets them pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.columns[:-1]
            h, begin = batch_word_hashes(batch.column(batch.num_columns - 1))
            for w in widths:
                at, g = _runs(h, begin, w)
                on = np.ones(len(at), dtype=bool)
                if bits is not None:
                    place = g & np.uint64(FILTER_BITS - 1)
                    on = (bits.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                owner = np.searchsorted(begin, at, side="right") - 1
                if len(keys) == 1 and w < width:
                    on &= np.diff(begin)[owner] == w
                pairs = np.unique(np.column_stack([owner[on], g[on].view(np.int64)]), axis=0)
                who = pa.array(pairs[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), *[k.take(who) for k in keys]], names=["h", *batch.schema.names[:-1]])

    return run


def _seed_filter(own: DataFrame) -> np.ndarray:
    """A bit for the lowest bits of each seed of items, put together from parts of 4 KB, one task each."""
    place = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = own.select(F.floor(place / _PART_BITS).cast("int").alias("part"), (place % _PART_BITS).cast("int").alias("at")).distinct()

    def packed(table: pa.Table) -> pa.Table:
        on = np.zeros(_PART_BITS, dtype=bool)
        on[table["at"].to_numpy()] = True
        return pa.table({"part": table["part"].slice(0, 1), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()])})

    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in rows.groupBy("part").applyInArrow(packed, "part int, bits binary").toLocalIterator():
        at = row["part"] * (_PART_BITS // 8)
        out[at : at + _PART_BITS // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _pairs(width: int):
    """Coverage of pairs (k1, k2, item, text, item's text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3):
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                found = _covered(Seeds(row.column(4), width), row.column(3))
                if found:
                    yield _rows(row.column(0), row.column(1), row.column(2).to_numpy(), [found[0][2]], [found[0][3]])

    return run


def item_coverage(keyed: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", width: int = MIN_MATCH, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Coverage of every pair of a text and an item's text that share a seed: k1, k2, item_id, n_tiles, coverage.

    ``keyed`` has k1, k2 (longs that name the text) and text. An item is an id
    of any type with one text; an id that repeats with several texts is as many
    items. Items without id or words match nothing.
    """
    spark = keyed.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.trim(normal(F.col(text_col))).alias("text")).where("text <> ''")
    items = items.distinct().withColumn("item", F.xxhash64(F.col("item_id").cast("string"), "text"))
    texts = keyed.select("k1", "k2", normal(F.col("text")).alias("text"))
    words = F.sum(F.size(F.split("text", " ")))
    if (items.agg(words).first()[0] or 0) <= broadcast_words:
        held = items.select("item", "text").orderBy("item").toArrow()
        names = held.column("item").to_numpy()
        shared = spark.sparkContext.broadcast((names, Seeds(held.column("text").combine_chunks(), width)))
        found = texts.mapInArrow(_probe(shared), _FOUND)
    else:
        widths = [r[0] for r in items.select(F.least(F.size(F.split("text", " ")), F.lit(width)).alias("w")).distinct().orderBy("w").collect()]
        own = materialize(items.select("item", "text").mapInArrow(_seed_hashes(widths, width), "h long, item long"), "seeds")
        bits = spark.sparkContext.broadcast(_seed_filter(own))
        met = texts.mapInArrow(_seed_hashes(widths, width, bits), "h long, k1 long, k2 long").join(own, "h").select("k1", "k2", "item").distinct()
        met = met.join(texts.dropDuplicates(["k1", "k2"]), ["k1", "k2"]).join(items.select("item", F.col("text").alias("item_text")), "item")
        found = met.select("k1", "k2", "item", "text", "item_text").mapInArrow(_pairs(width), _FOUND)
    return found.join(items.select("item", "item_id"), "item").select("k1", "k2", "item_id", "n_tiles", "coverage")


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """id, text and a name of 128 bits for both."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit(1), "text", "id")})


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = COVERAGE, **options) -> DataFrame:
    """One row per input row: id, n_items (item ids of which a text's coverage reaches ``threshold``), item_ids, max_coverage (0 if no seed is shared), contaminated.

    Null and empty texts are clean. Repeated rows give repeated results, also
    where ids repeat with different texts. An empty benchmark leaves all clean,
    an empty table gives no rows. Ties between equally long matches go to the
    earliest place in the item, then in the text. Very long texts are read
    whole. Ids of documents and items keep their type; other columns are not read.
    """
    keyed = _keyed(docs, text_col, id_col)
    found = item_coverage(keyed, benchmark, **options)
    hit = F.col("coverage") >= threshold
    # Rows that repeat id and text gave their pairs more than once.
    found = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.when(hit, F.col("item_id")))).alias("item_ids"), F.max("coverage").alias("max_coverage"))
    joined = keyed.select("id", "k1", "k2").join(found, ["k1", "k2"], "left")
    item_type = benchmark.select(options.get("item_col", "item_id")).schema[0].dataType.simpleString()
    none = F.array().cast(f"array<{item_type}>")
    out = joined.select(F.col("id").alias(id_col), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("max_coverage", F.lit(0.0)).alias("max_coverage"))
    n = F.size("item_ids").cast("long")
    return out.select(id_col, n.alias("n_items"), "item_ids", "max_coverage", (n > 0).alias("contaminated"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = COVERAGE, **options) -> DataFrame:
    """The rows that are not contaminated, all columns, under the rules of ``find_leaks``. Only the keys of contaminated rows are joined."""
    keyed = _keyed(docs, text_col, id_col)
    a, b, one, two = fresh(docs, "_key1", "_key2", "_gone1", "_gone2")
    gone = item_coverage(keyed, benchmark, **options).where(F.col("coverage") >= threshold).select(F.col("k1").alias(one), F.col("k2").alias(two)).distinct()
    named = docs.withColumns({a: F.xxhash64(id_col, text_col), b: F.xxhash64(F.lit(1), text_col, id_col)})
    return named.join(gone, (F.col(a) == F.col(one)) & (F.col(b) == F.col(two)), "left_anti").select(*docs.columns)
