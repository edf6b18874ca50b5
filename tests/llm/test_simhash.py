import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from barsmith.llm import simhash_dedup as S
from barsmith.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fp_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [fp_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, fps[i], low[find(i)]) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in df.collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["Ab", "çé", "x", "longer-word", "TEN", "ten", "0", "日本"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 5, 40])))) for i in range(300)]
    for i in range(300, 360):
        w = rows[i - 300][1].split()
        w[-1] = "changed"
        rows.append((i, "\t\n ".join(w)))
    rows += [(1000, ""), (1001, None), (1002, "  \n"), (7, rows[7][1]), (2000, "w " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(S.near_components(df)) == brute(rows)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(S.near_components(df)) == brute(rows)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, k string")
    assert S.near_components(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d", 5, "z"), (2, "a b c d", 6, "y"), (3, "q r s t u", 7, "x")], "doc_id long, text string, fp int, component_id string")
    assert [(r.doc_id, r.component_id) for r in S.near_components(df).orderBy("doc_id").collect()] == [(1, 1), (2, 1), (3, 3)]
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "x y z w"), (4, "x y z w"), (4, "x y z w")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in S.drop_near_duplicates(df).collect() if r.doc_id) == [(4, "x y z w")]
    assert S.drop_near_duplicates(df).count() == 3


def test_keys_meet_for_every_pair_within_two_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    for flips in (0, 1, 2):
        y = x.copy()
        for _ in range(flips):
            y ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
        (wa, ka), (wb, kb) = S.golay_keys(x), S.golay_keys(y)
        for i in range(len(x)):
            assert set(ka[wa == i]) & set(kb[wb == i])


def test_table_of_errors():
    t = S._error_table()
    weights = [[bin(e).count("1") for e in row if e >= 0] for row in t]
    assert sum(len(w) == 1 for w in weights) == 1 + 23 + 253 and sum(w == [3, 4, 4, 4, 4, 4] for w in weights) == 1771


@pytest.mark.parametrize("n", [50, 21_000])
def test_forest_of_a_large_bucket(n):
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    fp = np.unique(np.concatenate((fp, fp[:20] ^ np.uint64(3), fp[:20] ^ np.uint64(1 << 40))))
    edges = S.link_forest(fp, 2)
    assert all(bin(int(fp[a] ^ fp[b])).count("1") <= 2 for a, b in edges) and 40 <= len(edges) < len(fp)


def test_components_of_a_long_chain(spark):
    edges = [Row(a=i, b=i + 1) for i in range(40)] + [Row(a=100, b=101), Row(a=5, b=5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
