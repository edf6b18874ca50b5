"""SimHash near-duplicate detection by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last is
filled up with zeros). The perfect binary Golay code [23, 12, 7] maps a segment
to the indices of the codewords near it: one if the nearest codeword is within
two bits, otherwise that one and the five at distance four. Two segments that
differ in at most one bit always share an index. Fingerprints that differ in at
most two bits agree in at least one segment, and the segment that follows it
(cyclically, for one of the agreeing ones) differs in at most one bit: two
errors over three segments leave either two segments equal or one equal and two
with one error each. Hence the key (segment i as it is, index of segment i + 1)
meets for every pair to be linked; candidates that share a key are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, materialize, words
from .shingle_links import alike_components

#: Generator polynomial of the binary Golay code of length 23, and the segments (shift, bits).
GOLAY = 0xAE3
SEGMENTS = ((0, 23), (23, 23), (46, 18))

_PAIR_LANES = (1 << 32) | 1


# ----------------------------------------------------------- fingerprints


def shingle_hashes(tokens: F.Column, width: int) -> F.Column:
    """XXH64 (seed 42) of each run of ``width`` words joined by a space; of the whole if there are fewer; none for none.

    Spark's ``xxhash64`` of one string is XXH64 of its UTF-8 bytes with seed 42.
    """
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at(tokens, i + k) for k in range(width)])))
    whole = F.array(F.xxhash64(F.concat_ws(" ", tokens)))
    return F.when(n >= width, runs).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))


def bit_sums(h: str) -> list[F.Column]:
    """32 sums, each counting the set bits k (low half) and k + 32 (high half) of a column of hashes."""
    return [F.sum(F.shiftrightunsigned(F.col(h), k).bitwiseAND(F.lit(_PAIR_LANES))).alias(f"_s{k}") for k in range(32)]


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """One row per input row: the id and ``fp``, the majority fingerprint as a long.

    A bit is 1 if it is set in over half of the shingle hashes, repeats
    included. Words are made lower case in A-Z only. No word, or a null text:
    0. Repeated rows give repeated results. Extra columns are ignored. The
    counts of a row are gathered inside its task first, so one row per document
    is shuffled, however long the text.
    """
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), words(lower).alias("_w"))
    each = rows.select("_row", "_id", F.explode_outer(shingle_hashes(F.col("_w"), width)).alias("_h"))
    sums = each.groupBy("_row", "_id").agg(F.count("_h").alias("_n"), *bit_sums("_h"))
    bits = []
    for k in range(32):
        s = F.coalesce(F.col(f"_s{k}"), F.lit(0))
        low, high = s.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(s, 32)
        bits.append(F.when(low * 2 > F.col("_n"), F.lit(1 << k)).otherwise(F.lit(0)))
        top = 1 << (k + 32)
        bits.append(F.when(high * 2 > F.col("_n"), F.lit(top - (1 << 64) if top >> 63 else top)).otherwise(F.lit(0)))
    fp = bits[0]
    for bit in bits[1:]:
        fp = fp.bitwiseOR(bit)
    return sums.select(F.col("_id").alias(id_col), fp.cast("long").alias("fp"))


# ------------------------------------------------------------ Golay keys


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    for bit in range(22, 10, -1):
        v = np.where(v >> bit & 1, v ^ (GOLAY << (bit - 11)), v)
    return v


def _error_table() -> np.ndarray:
    """For each syndrome, the (one or six) error patterns of up to four bits that lead to a codeword."""
    table = np.full((2048, 6), -1, dtype=np.int64)
    for weight in range(4):
        for at in combinations(range(23), weight):
            e = sum(1 << b for b in at)
            table[_syndrome(np.array([e]))[0], 0] = e
    used = np.ones(2048, dtype=np.int64)
    for s in range(2048):
        if bin(table[s, 0]).count("1") < 3:
            continue
        for b in range(23):
            e = int(table[s ^ int(_syndrome(np.array([1 << b]))[0]), 0]) ^ (1 << b)
            if bin(e).count("1") == 4 and e not in table[s]:
                table[s, used[s]] = e
                used[s] += 1
    return table


_TABLES: list[np.ndarray] = []


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64): for each key the position of its fingerprint, and the key."""
    if not _TABLES:
        _TABLES.append(_error_table())
    table, who, keys = _TABLES[0], [], []
    parts = [((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
    for i in range(3):
        exact, near = parts[i], parts[(i + 1) % 3]
        errors = table[_syndrome(near)]
        index = (near[:, None] ^ errors) >> 11
        key = (np.int64(i) << 40) | (exact[:, None] << 12) | index
        rows, cols = np.nonzero(errors >= 0)
        who.append(rows)
        keys.append(key[rows, cols])
    return np.concatenate(who), np.concatenate(keys)


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        who, keys = golay_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[who])], names=["k", "fp"])


# --------------------------------------------------------------- verify


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def link_forest(fp: np.ndarray, distance: int, block: int = 512) -> list[tuple[int, int]]:
    """Edges (as positions) of a forest that joins all fingerprints of a bucket within ``distance`` bits.

    All pairs are compared in blocks that don't grow with the bucket; past the
    size where single and double bit flips are fewer than the partners, those
    are looked up instead, so the work stays linear in the bucket. Only edges
    that join two trees are kept: at most one less than there are members.
    """
    n, root, edges = len(fp), list(range(len(fp))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            edges.append((i, j))

    if n <= 20_000 or distance > 2:
        for i in range(0, n, block):
            for j in range(i, n, block * 8):
                near = _popcount(fp[i : i + block, None] ^ fp[None, j : j + block * 8]) <= distance
                for a, b in zip(*np.nonzero(near), strict=True):
                    if i + a < j + b:
                        join(i + int(a), j + int(b))
        return edges
    order = np.argsort(fp)
    ordered = fp[order]
    for flips in range(1, distance + 1):
        for at in combinations(range(64), flips):
            other = fp ^ np.uint64(sum(1 << b for b in at))
            where = np.minimum(np.searchsorted(ordered, other), n - 1)
            for i in np.flatnonzero(ordered[where] == other):
                join(int(i), int(order[where[i]]))
    return edges


def _forests(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a bucket may cross batches and is held until it is whole."""
        held_k, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def edges_of(k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(k)) + 1
            start, stop = np.concatenate(([0], cut)), np.concatenate((cut, [len(k)]))
            a, b = [], []
            for i, j in zip(start[stop - start > 1], stop[stop - start > 1], strict=True):
                part = np.unique(fp[i:j])
                for x, y in link_forest(part, distance):
                    a.append(part[x])
                    b.append(part[y])
            cols = [np.array(c, dtype=np.uint64).view(np.int64) for c in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b"])

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            k, fp = np.concatenate((held_k, k)), np.concatenate((held_fp, fp))
            if not len(k):
                continue
            whole = int(np.searchsorted(k, k[-1], side="left"))
            if whole:
                yield edges_of(k[:whole], fp[:whole])
            held_k, held_fp = k[whole:], fp[whole:]
        if len(held_k):
            yield edges_of(held_k, held_fp)

    return run


def near_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Edges ``a``, ``b`` between different fingerprints whose closure is that of all pairs within ``distance`` (2 at most)."""
    if not 0 <= distance <= 2:
        raise ValueError("the keys hold for 0, 1 or 2 differing bits")
    distinct = prints.select("fp").distinct()
    keys = distinct.mapInArrow(_keys_of, "k long, fp long")
    return keys.repartition("k").sortWithinPartitions("k").mapInArrow(_forests(distance), "a long, b long").distinct()


def near_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3, distance: int = 2) -> DataFrame:
    """One row per input row: id, ``fp`` and ``component_id``, the smallest id reachable over links.

    Texts without words have fingerprint 0 and link like any other. A null id
    never is a component's name unless all ids of the component are null. An
    empty table gives an empty result. Repeated rows give the same row each, and
    columns beside id and text are not read, whatever their names. Shingles of
    texts of any length are counted whole. Groups of equal fingerprints are single
    nodes, so a group of copies of any size adds one node and no pairs.
    """
    prints = materialize(fingerprints(docs, text_col, id_col, width), "fp")
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("_low"))
    roots = materialize(connected_components(near_links(prints, distance)), "roots")
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "_low", F.coalesce("root", "fp").alias("_root"))
    lows = named.groupBy("_root").agg(F.min("_low").alias("component_id"))
    named = named.join(lows, "_root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Keep one document of each component of texts whose five-word shingles are alike to 0.8 or more: that with the smallest id (one row of it, if rows repeat).

    Rows with a null id can't be named as copies; one stays for each distinct
    text. Texts without words are one component. An empty table stays empty.
    Very long texts are compared whole. All columns stay as they are. Candidates
    are texts whose fingerprints ``near_links`` joins over Golay keys, and, as
    alike texts may differ in more than two bits, those that share a band of
    minimum hashes; all are verified on their shingles. Which
    ids and texts stand in several rows that would stay is found over narrow
    rows, and only such rows are shuffled to keep one of each.
    """
    keep, tag = fresh(docs, "_keep", "_tag")
    ids = alike_components(docs, near_links, text_col, id_col).where(F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id")))
    ids = materialize(ids.groupBy(F.col(id_col).alias(keep)).agg(F.count(F.lit(1)).alias("_n")), "kept")
    once = ids.where(F.col("_n") == 1).select(keep)
    more = ids.where(F.col("_n") > 1).select(keep)
    single = docs.join(once, docs[id_col].eqNullSafe(F.col(keep)), "left_semi")
    several = docs.join(more, docs[id_col].eqNullSafe(F.col(keep)), "left_semi")
    name = F.coalesce(F.col(id_col).cast("string"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return single.unionByName(several.withColumn(tag, name).dropDuplicates([tag]).drop(tag))
