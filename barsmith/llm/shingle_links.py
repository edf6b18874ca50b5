"""Near-duplicate texts by five-word shingles alike to 0.8 or more, exactly verified.

Texts with the same set of shingles are one node. Each set has a SimHash
fingerprint; fingerprints that the caller links (by Golay keys, see
``simhash_dedup``) are a bucket of candidates. Sets may be alike to 0.8 and yet
differ in a dozen bits, so candidates also meet in buckets of
minimum hashes: ``BANDS`` bands of ``ROWS`` minima each, of which two sets alike
to 0.8 share none with probability (1 - 0.8 ** 5) ** 32, 3 in a million, and less
the more alike they are. Buckets with the same members are one. In a bucket,
sets are compared by their exact Jaccard likeness, and only pairs that aren't
joined yet, so a group of near copies costs about one comparison a member. A
task holds the sets of one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_word_hashes, connected_components, group_bounds, materialize, mix64, sliced, whole_groups

#: Words of a shingle, bands and minima a band. Two sets are alike if 5 * shared >= 4 * united.
WIDTH, BANDS, ROWS = 5, 32, 5
#: Bands of the first round.
FIRST = 3
_rng = np.random.Generator(np.random.PCG64(5080))
_WORD_CODE = _rng.integers(0, 1 << 63, size=WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW_CODE = _rng.integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, repeats included, and where each text's begin (n + 1).

    Letters A-Z count as lower case. A text of fewer words is one shingle, one without words has none.
    """
    h, begin = batch_word_hashes(pc.ascii_lower(column))
    n = np.diff(begin)
    take = np.arange(len(h)) + WIDTH <= np.repeat(begin[1:], n)
    value = np.zeros(len(h), dtype=np.uint64)
    if len(h) >= WIDTH:
        runs = value[: len(h) - WIDTH + 1]
        for j in range(WIDTH):
            runs += h[j : len(h) - WIDTH + 1 + j] * _WORD_CODE[j]
    for size in range(1, WIDTH):
        at = begin[:-1][n == size]
        take[at] = True
        value[at] = sum((h[at + j] * _WORD_CODE[j] for j in range(size)), np.full(len(at), size, dtype=np.uint64) * _ODD)
    count = np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
    return mix64(value[take]), np.concatenate(([0], np.cumsum(count)))


def band_keys(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One row of band keys for each (not empty) set of hashes."""
    out = np.empty((len(start), BANDS), dtype=np.uint64)
    if not len(start):
        return out
    for band in range(BANDS):
        key = np.full(len(start), band, dtype=np.uint64)
        for code in _ROW_CODE[band * ROWS : (band + 1) * ROWS]:
            key = mix64(key * _ODD + np.minimum.reduceat(hashes * code, start))
        out[:, band] = key
    return out


def majority(hashes: np.ndarray, slice_: int = 1 << 16) -> np.uint64:
    """SimHash fingerprint: a bit is 1 if it is set in over half of the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), slice_):
        part = np.ascontiguousarray(hashes[at : at + slice_], dtype="<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node of each text (a hash of its set of shingles), the set's fingerprint (null for none) and its band keys."""
    for batch in sliced(batches, 2):
        hashes, begin = shingles(batch.column(2))
        full = np.diff(begin) > 0
        node, fp = np.zeros(batch.num_rows, dtype=np.uint64), np.zeros(batch.num_rows, dtype=np.uint64)
        for i in np.flatnonzero(full):
            own = np.unique(hashes[begin[i] : begin[i + 1]])
            node[i] = mix64(own + _ODD).sum(dtype=np.uint64) + np.uint64(len(own))
            fp[i] = majority(own)
        keys = band_keys(hashes, begin[:-1][full])
        offsets = np.concatenate(([0], np.cumsum(full * BANDS))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mix64(node).view(np.int64)), pa.array(fp.view(np.int64), mask=~full), lists], names=["_row", "_id", "_text", "t", "fp", "keys"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each bucket of two nodes or more, under a hash of the member set. Rows come sorted by key and node."""
    for k, t in whole_groups(batches, 1):
        start, stop = group_bounds([k])
        many = stop - start
        name = mix64(np.add.reduceat(mix64(t.view(np.uint64) ^ _ODD), start) + many.astype(np.uint64))
        on = np.repeat(many > 1, many)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, many)[on].view(np.int64)), pa.array(t[on])], names=["b", "t"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        hashes, begin = shingles(batch.column(1))
        own = [np.unique(hashes[i:j].view(np.int64)) for i, j in zip(begin[:-1], begin[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["t", "s"])


def alike_forest(sets: list[np.ndarray], groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges of a forest that joins all (sorted, not empty) sets alike to 0.8; pairs already joined, also by ``groups``, are not compared."""
    size, edges = np.array([len(s) for s in sets]), []
    label = np.arange(len(sets)) if groups is None else np.unique(groups, return_inverse=True)[1]
    for i in range(1, len(sets)):
        stop, step = i, 16
        while stop:
            begin = max(0, stop - step)
            other = begin + np.flatnonzero(label[begin:stop] != label[i])
            other = other[5 * np.minimum(size[other], size[i]) >= 4 * np.maximum(size[other], size[i])]
            if len(other):
                values = np.concatenate([sets[j] for j in other])
                hit = sets[i][np.minimum(np.searchsorted(sets[i], values), size[i] - 1)] == values
                both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(size[other])[:-1])))
                for j in other[9 * both >= 4 * (size[other] + size[i])]:
                    if label[j] != label[i]:
                        edges.append((i, int(j)))
                        label[label == label[j]] = label[i]
            stop, step = begin, min(4 * step, 1024)
    return edges


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each bucket. Rows (bucket, node, its component so far, set) come sorted by bucket, which is held until it is whole."""
    held, nodes, groups, sets = None, [], [], []

    def edges() -> pa.RecordBatch:
        found = alike_forest(sets, groups)
        return pa.RecordBatch.from_arrays([pa.array([nodes[x[side]] for x in found], pa.int64()) for side in (0, 1)], names=["a", "b"])

    for batch in batches:
        lists = batch.column(3)
        spot, values = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False)
        for i, (b, t, c) in enumerate(zip(*[batch.column(j).to_pylist() for j in range(3)], strict=True)):
            if b != held and sets:
                yield edges()
                nodes, groups, sets = [], [], []
            held = b
            nodes.append(t)
            groups.append(c)
            sets.append(values[spot[i] : spot[i + 1]].copy())
    if sets:
        yield edges()


def near_buckets(nodes: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bucket key of each node by its fingerprint: one for all that reach each other over the links ``a``, ``b`` that ``near`` gives for fingerprints ``fp``."""
    prints = nodes.where(F.col("fp").isNotNull()).select("t", "fp")
    roots = materialize(connected_components(near(prints)), "near")
    return prints.join(roots, prints.fp == roots.node, "left").select(F.xxhash64(F.coalesce("root", "fp"), F.lit(BANDS)).alias("k"), "t")


def _links(prints: DataFrame, nodes: DataFrame, bands: tuple[int, int], joined: DataFrame | None, more: DataFrame | None = None) -> DataFrame:
    """Verified edges of the buckets of some bands, and of those of ``more`` (k, t); buckets whose members ``joined`` has in one component are passed over."""
    keys = prints.select("t", "keys").dropDuplicates(["t"]).select(F.posexplode("keys").alias("_band", "k"), "t").where(F.col("_band").between(*bands)).select("k", "t")
    if more is not None:
        keys = keys.unionByName(more)
    members = keys.repartition("k").sortWithinPartitions("k", "t").select("k", "t").mapInArrow(_shared, "b long, t long").distinct()
    if joined is None:
        members = members.withColumn("c", F.col("t"))
    else:
        members = members.join(joined, members.t == joined.node, "left").select("b", "t", F.coalesce("root", "t").alias("c"))
        # A bucket that may join something holds two components at least.
        apart = members.groupBy("b").agg(F.min("c").alias("_low"), F.max("c").alias("_high")).where("_low <> _high").select("b")
        members = members.join(apart, "b", "left_semi")
    members = materialize(members, "buckets")
    # One row of each node that shares a bucket brings its text.
    wanted = nodes.join(members.select("t").distinct(), "t", "left_semi").select("_row")
    sets = prints.select("_row", "t", "_text").join(wanted, "_row", "left_semi").select("t", "_text").mapInArrow(_sets, "t long, s array<long>")
    met = members.join(sets, "t").select("b", "t", "c", "s")
    return materialize(met.repartition("b").sortWithinPartitions("b", "t").mapInArrow(_verified, "a long, b long").distinct(), "links")


def alike_components(docs: DataFrame, near: Callable[[DataFrame], DataFrame], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id and ``component_id``, the smallest id reachable over pairs alike to 0.8.

    Texts without words are one node. A null id never is a component's name
    unless all its ids are null. An empty table gives an empty result. Repeated
    rows and texts with the same shingles are one node and give the same row
    each. Very long texts are compared whole. Other columns are not read.

    ``near`` links fingerprints (see ``near_buckets``). Their buckets and the
    first bands join most of what belongs together; sets of shingles then travel
    only for buckets of the other bands that hold more than one component.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    prints = materialize(rows.mapInArrow(_prints, f"_row long, _id {id_type}, _text string, t long, fp long, keys array<long>"), "shingles")
    nodes = prints.groupBy("t").agg(F.min("_id").alias("_low"), F.min("_row").alias("_row"), F.max("fp").alias("fp"))
    first = _links(prints, nodes, (0, FIRST - 1), None, near_buckets(nodes, near))
    edges = first.unionByName(_links(prints, nodes, (FIRST, BANDS - 1), materialize(connected_components(first), "joined")))
    roots = materialize(connected_components(edges), "roots")
    named = nodes.join(roots, nodes.t == roots.node, "left").select("t", "_low", F.coalesce("root", "t").alias("_root"))
    lows = named.groupBy("_root").agg(F.min("_low").alias("component_id"))
    named = named.join(lows, "_root").select("t", "component_id")
    return prints.select(F.col("_id").alias(id_col), "t").join(named, "t").select(id_col, "component_id")
