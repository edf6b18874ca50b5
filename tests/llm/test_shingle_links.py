import random

import numpy as np

from barsmith.llm import shingle_links as L
from barsmith.llm import simhash_dedup
from barsmith.llm.simhash_dedup import drop_near_duplicates


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute(rows):
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return {min(rows[j][0] for j in range(len(rows)) if root[j] == r) for r in root}


def test_near_copies_with_edits_go_and_unlike_texts_stay(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 30, 120]))]
        rows.append((10 * i, " ".join(w)))
        for j in range(1, rng.randrange(1, 6)):
            v = list(w)
            for _ in range(rng.randrange(0, 5)):
                v[rng.randrange(len(v))] = "edited"
            rows.append((10 * i + j, " ".join(v).upper() if j % 2 else "  ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert len(want) < len(rows) - 20
    assert {r.doc_id for r in drop_near_duplicates(df).collect()} == want


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 62, 50)) for _ in range(6)]
    sets = [np.sort(np.concatenate((b[k:], rng.integers(0, 1 << 62, k)))) for b in base for k in rng.integers(0, 12, 40)]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    edges = L.alike_forest(sets)
    assert len(edges) == len(sets) - len(set(root)) and all(root[a] == root[b] for a, b in edges)


def test_fingerprints_linked_by_golay_keys_are_candidates(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(30):
        w = [f"w{rng.randrange(9000)}" for _ in range(900)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-1] + ["edited"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    near_links = simhash_dedup.near_links
    monkeypatch.setattr(simhash_dedup, "near_links", lambda prints: seen.append(near_links(prints)) or seen[-1])
    assert {r.doc_id for r in drop_near_duplicates(df).collect()} == {2 * i for i in range(30)}
    # Without any band the pairs within two bits are joined all the same.
    prints = df.selectExpr("doc_id _row", "doc_id _id", "text _text").mapInArrow(L._prints, "_row long, _id long, _text string, t long, fp long, keys array<long>").cache()
    nodes = prints.groupBy("t").agg({"_row": "min", "fp": "max"}).toDF("t", "_row", "fp")
    row = {r.t: r for r in nodes.collect()}
    by_id = {r._row: r for r in row.values()}
    close = {i for i in range(30) if bin((by_id[2 * i].fp ^ by_id[2 * i + 1].fp) & (1 << 64) - 1).count("1") <= 2}
    found = L._links(prints, nodes, (0, -1), None, L.near_buckets(nodes, near_links)).collect()
    assert len(seen) == 1 and len(close) > 15
    assert {frozenset((row[r.a]._row, row[r.b]._row)) for r in found} == {frozenset((2 * i, 2 * i + 1)) for i in close}
    texts = np.array([3, 1 << 63 | 1, 1 << 63], dtype=np.uint64)
    assert int(L.majority(texts, 2)) == (1 << 63 | 1)
