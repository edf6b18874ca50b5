"""Ranked search of texts by MaxScore with bounds of term pairs.

One pass over the texts counts the terms that queries hold (``forward``). Its
rows are cut into blocks of bounded size and turned into an index: for each term
of a block its list of documents with their impacts and the largest impact, and
for each pair of terms that stand next to each other in a query (in order of
weight) the intersection of both lists, kept as the largest joint impact and the
``k`` best joint impacts. Queries are then answered block by block.

A document's score from a set of terms is at most the sum of their largest
impacts; where two of them have a pair bound, max(joint, either alone), their sum
is replaced by it. The least such sum over disjoint pairs of neighbours is found
by a recurrence along the query's terms. Terms whose combined bound stays below
the k-th score can't bring in a document by themselves, so only lists of the
other terms are walked, and a document whose score so far plus the bound of what
is left can't reach the k-th score is given up. The k-th best impact of a term,
or joint impact of a pair, over all blocks is a threshold from the start.

Whole numbers throughout, as the ranking contract says; only weights take one
logarithm. Null texts and texts without a term take no part and don't count.
Repeated documents are ranked each; ties go to the smaller doc_id, null ids last.
Items equal in id and text are one item; the same id with two texts is ranked for
each. Empty tables give no rows. Very long texts are counted slice by slice.
Other columns of both tables, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, sliced

#: Documents of a block of the index, and terms of the queries that are answered in one pass.
DOCS, TERMS = 1 << 13, 1 << 17
_SLICE = 1 << 20
#: Bytes of terms stay (letters and digits, A-Z in lower case, and all of non-ASCII characters); others become a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def term_slices(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, a bounded slice at a time, cut between terms."""
    at = 0
    while at < len(data):
        part = data[at : at + _SLICE].translate(_TABLE)
        if at + _SLICE < len(data):
            cut = part.rfind(b" ") + 1
            while not cut:  # a term longer than a slice
                more = data[at + len(part) : at + len(part) + _SLICE].translate(_TABLE)
                if not more:
                    cut = len(part)
                    break
                found = more.find(b" ")
                part += more if found < 0 else more[: found + 1]
                cut = len(part) if found >= 0 else 0
            part = part[:cut]
        yield part.split()
        at += len(part)


def forward(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """doc, n (terms with repeats), terms, tf: of every document with a term, how often it holds those of a vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            keep, sizes, terms, tfs = [], [], [], []
            for at, data in enumerate(batch.column(1)):
                n, held = 0, Counter()
                for part in term_slices(data.as_py() or b""):
                    n += len(part)
                    held.update(part)
                    if len(held) > _SLICE:  # only what queries hold is kept of a very long text
                        held = Counter({t: c for t, c in held.items() if t in vocabulary})
                if n:
                    own = sorted((vocabulary[t], c) for t, c in held.items() if t in vocabulary)
                    keep.append(at)
                    sizes.append(n)
                    terms.append([t for t, _ in own])
                    tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc", "n", "terms", "tf"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(count, f"doc {dict(rows.dtypes)['doc']}, n long, terms array<int>, tf array<long>")


def _impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m)), m = 100 - 90 + ((90 n N) div L)."""
    if 90.0 * float(n.max(initial=0)) * total < 2.0**62:
        m = 10 + (90 * n * total) // length
    else:
        m = np.array([10 + (90 * int(v) * total) // length for v in n], dtype=np.int64)
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def block_index(rows: DataFrame, weights: np.ndarray, pairs: dict[int, list[int]], total: int, length: int, k: int, size: int = DOCS) -> DataFrame:
    """Index of a ``forward`` table, a row for each list: block, a, b, docs, impacts, top, best, ids.

    A term has b = -1, its places in the block and impacts; a pair has only
    ``top`` and ``best``, the ``k`` best joint impacts of its intersection. The
    row with a = -1 holds the ids of the block, in order.
    """
    kind = dict(rows.dtypes)["doc"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - count)
                held.append(part)
                at, count = at + part.num_rows, count + part.num_rows
                if count == size:
                    yield one(number, pa.Table.from_batches(held))
                    number, held, count = number + 1, [], 0
        if count:
            yield one(number, pa.Table.from_batches(held))

    def one(number: int, table: pa.Table) -> pa.RecordBatch:
        table = table.take(pc.sort_indices(table, [("doc", "ascending")], null_placement="at_end"))
        terms = table["terms"].combine_chunks()
        place = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        term, tf = terms.flatten().to_numpy(), table["tf"].combine_chunks().flatten().to_numpy()
        impact = _impacts(weights[term], tf, table["n"].to_numpy()[place], total, length)
        by_term = np.argsort(term, kind="stable")
        term, place, impact = term[by_term], place[by_term].astype(np.int32), impact[by_term]
        names, start = np.unique(term, return_index=True)
        ends, where = np.append(start[1:], len(term)), {int(t): i for i, t in enumerate(names)}
        out: dict[str, list] = {"a": [-1], "b": [-1], "docs": [[]], "impacts": [[]], "best": [[]]}

        def add(a: int, b: int, docs, impacts, joint: np.ndarray) -> None:
            best = joint if len(joint) <= k else np.partition(joint, len(joint) - k)[len(joint) - k :]
            for name, v in (("a", a), ("b", b), ("docs", docs), ("impacts", impacts), ("best", np.sort(best)[::-1])):
                out[name].append(v)

        board = np.zeros(len(table), dtype=np.int64)
        for i, a in enumerate(names):
            own, value = place[start[i] : ends[i]], impact[start[i] : ends[i]]
            add(int(a), -1, own, value, value)
            partners = [where[b] for b in pairs.get(int(a), ()) if b in where]
            if partners:
                board[own] = value + 1  # an impact may be 0
                for j in partners:
                    other = board[place[start[j] : ends[j]]]
                    both = other > 0
                    if both.any():
                        add(int(a), int(names[j]), [], [], other[both] - 1 + impact[start[j] : ends[j]][both])
                board[own] = 0
        ids = table["doc"].combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * len(out["a"])], pa.int32()), ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number] * len(out["a"]), pa.int64()), pa.array(out["a"], pa.int32()), pa.array(out["b"], pa.int32()), pa.array(out["docs"], pa.list_(pa.int32())), pa.array(out["impacts"], pa.list_(pa.int64())),
                pa.array([int(x[0]) if len(x) else 0 for x in out["best"]], pa.int64()), pa.array(out["best"], pa.list_(pa.int64())), lists,
            ],
            ["block", "a", "b", "docs", "impacts", "top", "best", "ids"],
        )

    return rows.mapInArrow(build, f"block long, a int, b int, docs array<int>, impacts array<long>, top long, best array<long>, ids array<{kind}>")


def prefix_bounds(tops: list[int], joints: list[int]) -> list[int]:
    """bound[i]: the most that any document can score from the first i terms; joints[i] bounds terms i and i + 1 together.

    The least sum over disjoint pairs of neighbours and single terms.
    """
    bound = [0]
    for i, top in enumerate(tops):
        single = bound[i] + top
        bound.append(min(single, bound[i - 1] + joints[i - 1]) if i else single)
    return bound


def best_in_block(lists: list[tuple[np.ndarray, np.ndarray, int]], joints: list[int], size: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the ``k`` best documents of a block that score at least ``floor``, and how many postings were walked.

    ``lists`` are the query's terms in order of weight: places, impacts, largest impact.
    """
    bound = prefix_bounds([top for _, _, top in lists], joints)
    threshold, walked = max(floor, 1), 0
    first = 0
    while first < len(lists) and bound[first + 1] < threshold:
        first += 1
    score, alive = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
    for places, impacts, _ in reversed(lists[first:]):
        score[places] += impacts
        alive[places] = True
        walked += len(places)
    found = np.flatnonzero(alive)
    for i in range(first - 1, -1, -1):
        if len(found) >= k:
            threshold = max(threshold, int(np.partition(score[found], len(found) - k)[len(found) - k]))
        found = found[score[found] + bound[i + 1] >= threshold]
        if not len(found):
            break
        keep = np.zeros(size, dtype=bool)
        keep[found] = True
        places, impacts, _ = lists[i]
        inside = keep[places]
        score[places[inside]] += impacts[inside]
        walked += int(inside.sum())
    found = found[score[found] >= threshold]
    found = found[np.lexsort((found, -score[found]))[:k]]
    return found, score[found], walked


def _search(items: list[tuple[int, list[int]]], floors: dict[int, int], k: int):
    """Answers all queries on one block of the index."""

    def answer(table: pa.Table) -> pa.Table:
        single, joint, ids = {}, {}, None
        a, b, top = table["a"].to_pylist(), table["b"].to_pylist(), table["top"].to_pylist()
        docs, impacts = table["docs"].combine_chunks(), table["impacts"].combine_chunks()
        starts, flat, values = docs.offsets.to_numpy(), docs.values.to_numpy(), impacts.values.to_numpy()
        others = impacts.offsets.to_numpy()
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            if x < 0:
                ids = table["ids"].combine_chunks()[i].values
            elif y < 0:
                single[x] = (flat[starts[i] : starts[i + 1]], values[others[i] : others[i + 1]], top[i])
            else:
                joint[(x, y)] = top[i]
        item, place, score = [], [], []
        for name, terms in items:
            held = [t for t in terms if t in single]
            if not held:
                continue
            bounds = []
            for x, y in zip(held, held[1:], strict=False):
                tops = single[x][2], single[y][2]
                # Neighbours in the query have a pair list; with none in this block they never meet here.
                known = (x, y) in neighbours
                bounds.append(max(joint.get((x, y), 0), *tops) if known else sum(tops))
            places, scores, _ = best_in_block([single[t] for t in held], bounds, len(ids), k, floors.get(name, 0))
            item += [name] * len(places)
            place.append(places)
            score.append(scores)
        at = np.concatenate(place) if place else np.empty(0, dtype=np.int64)
        return pa.table({"item": pa.array(item, pa.int32()), "doc": ids.take(pa.array(at, pa.int64())), "score": pa.array(np.concatenate(score) if score else [], pa.int64())})

    neighbours = {p for _, terms in items for p in zip(terms, terms[1:], strict=False)}
    return answer


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``k`` best documents with a score above 0.

    Queries are taken in blocks of about TERMS terms (or one item): a block is
    what is sent to every task, and costs one pass over the texts.
    """

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted({t.decode() for part in term_slices(data.as_py()) for t in part}) for data in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.string())), batch.column(2)], ["id", "terms", "key"])

    kind = dict(items.dtypes)[item_id]
    asked = items.select(F.col(f"`{item_id}`").alias("id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).cast("binary").alias("text")).distinct()
    asked = asked.withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit(":"), F.hex("text")).cast("binary"))))
    asked = materialize(asked.mapInArrow(terms_of, f"id {kind}, terms array<string>, key binary"), "items").where(F.size("terms") > 0)
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // TERMS))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    answers = [_answer(docs, asked.where(F.col("part") == b).orderBy("key").collect(), k, doc_id, text) for b in range(blocks)]
    found = answers[0]
    for more in answers[1:]:
        found = found.union(more)
    w = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = best.join(asked.select("key", F.col("id").alias("item")), "key")
    return out.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id if doc_id != item_id else f"found_{doc_id}"), "score")


def _answer(docs: DataFrame, asked: list, k: int, doc_id: str, text: str) -> DataFrame:
    """key, doc, score: candidates for the ``k`` best of each item of one block of queries."""
    spark = docs.sparkSession
    names = sorted({t for r in asked for t in r["terms"]})
    vocabulary = {t.encode(): i for i, t in enumerate(names)}
    rows = materialize(forward(docs, vocabulary, doc_id, text), "forward")
    kind = dict(rows.dtypes)["doc"]
    total, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["t"]: r["df"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = np.array([math.floor(1000 * math.log((2.0 * total + 2) / (2.0 * df.get(i, 0) + 1))) for i in range(len(names))], dtype=np.int64)
    if not total or not names:
        return spark.createDataFrame([], f"key binary, doc {kind}, score long")
    at = {t: i for i, t in enumerate(names)}
    # Terms that no document holds play no part; the others stand in order of weight.
    queries = [(i, sorted((at[t] for t in r["terms"] if at[t] in df), key=lambda t: (weights[t], t))) for i, r in enumerate(asked)]
    pairs: dict[int, list[int]] = {}
    for x, y in sorted({p for _, terms in queries for p in zip(terms, terms[1:], strict=False)}):
        pairs.setdefault(x, []).append(y)
    index = materialize(block_index(rows, weights, pairs, total, length, k), "index")
    each = index.where("a >= 0").select("a", "b", F.explode("best").alias("v"))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("v")))
    kth = {(r["a"], r["b"]): r["v"] for r in each.withColumn("_rn", place).where(F.col("_rn") <= k).where(F.col("_rn") == k).collect()}
    floors = {i: max([kth.get((t, -1), 0) for t in terms] + [kth.get(p, 0) for p in zip(terms, terms[1:], strict=False)], default=0) for i, terms in queries}
    found = index.groupBy("block").applyInArrow(_search(queries, floors, k), f"item int, doc {kind}, score long")
    keys = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(asked)], "item int, key binary")
    return found.join(F.broadcast(keys), "item").select("key", "doc", "score")


def oracle(docs: str = "documents", items: str = "benchmark", k: int = 10) -> str:
    """The same ranking by joining all terms."""
    low = f"translate({{}}, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({low.format("text")}, '{pattern}') AS t FROM {docs}),
u AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS nn, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM u GROUP BY ALL),
q AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all({low.format("text")}, '{pattern}')) AS term FROM (SELECT DISTINCT item_id, text FROM {items})),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn::DOUBLE + 2) / (2 * count(*)::DOUBLE + 1))) AS BIGINT) AS w FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, nn),
m AS (SELECT item_id, q.text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, q.text, r, doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM m WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {k}
"""
