"""Top-k search, whitening and ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.llm import ranked_search, threshold_search, whitening

VECTORS = "vec_id long, embedding array<float>, x int, score string"


def brute_top(rows, k, every):
    good = {(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = set()
    for q, a in good:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("strip,block", [(1 << 15, 1 << 11), (40, 7)])
def test_top_k_equals_brute_force(spark, strip, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, 0.2, 6)]) for i in range(200)]
    rows += [(1000 + i, [0.25] * 6) for i in range(120)]  # one vector held by many
    rows += [(2000 + i, [0.0] * 6) for i in range(5)] + [(0, None), (5, [None] * 6), (10, [float("nan")] * 6), (15, [float("inf")] + [0.1] * 5), (None, [0.1] * 6)]
    rows += [(3000, [0.5, 0.5]), (3001, [0.5, -0.5]), (3005, []), (20, rows[20][1]), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], VECTORS)
    got = threshold_search.top_inner_products(df, F.col("id") % 5 == 0, k=5, strip=strip, block=block).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute_top(rows, 5, 5)
    assert len(got) == len({(r.query_id, r["rank"]) for r in got})


def test_top_k_of_huge_components_and_of_nothing(spark):
    rows = [(i, [float(s * 2.0**e)] * 2) for i, (s, e) in enumerate([(1, 20), (-1, 30), (1, 40), (1, 3)])]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], VECTORS)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in threshold_search.top_inner_products(df, F.col("id") >= 0, k=2).collect()}
    clip = {(q, r, i, max(-(1 << 63), min(s, (1 << 63) - 1))) for q, r, i, s in brute_top(rows, 2, 1)}
    assert got == clip
    assert threshold_search.top_inner_products(df.where("false"), F.col("id") >= 0).count() == 0


def exact_top(rows, k, every):
    """As ``brute_top``, with 64-bit scores; a list, as each vector of an id is a query."""
    good = sorted({(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows})
    out = []
    for q, a in good:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q)[:k]
            out += [(q, r + 1, i, max(-(1 << 63), min(-s, (1 << 63) - 1))) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("strip", [1 << 15, 10])
def test_top_k_beyond_64_bits_is_ranked_exactly(spark, strip):
    rng = np.random.default_rng(11)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 3) * 10.0 ** rng.integers(-3, 36)]) for i in range(80)]
    rows += [(100, [1.0, 1.0, 0.0]), (101, [1e30, -1e30, 0.5]), (102, [2e30, -1e30, 0.0]), (103, [1e30, 1e30, 0.0]), (104, [3e38, 3e38, 0.0]), (110, [1e20, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], VECTORS)
    got = threshold_search.top_inner_products(df, F.col("id") % 2 == 0, k=5, strip=strip, block=7).collect()
    assert sorted(tuple(r) for r in got) == exact_top(rows, 5, 2)


@pytest.mark.parametrize("strip", [1 << 15, 10])
def test_top_k_of_ids_with_several_vectors_is_whole(spark, strip):
    rng = np.random.default_rng(12)
    rows = [(i, [float(c) for c in rng.normal(0, 0.2, 4)]) for i in range(60)]
    rows += [(10, [float(c) for c in 3 * np.array(rows[10][1]) + rng.normal(0, 0.01, 4)]) for _ in range(8)]  # they would take all places of id 10
    rows += [(200 + i, rows[-1][1]) for i in range(9)] + [(7, rows[8][1])]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], VECTORS)
    got = threshold_search.top_inner_products(df, F.col("id") % 5 == 0, k=5, strip=strip, block=7).collect()
    assert sorted(tuple(r) for r in got) == exact_top(rows, 5, 5)


def test_threshold_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.standard_t(2, (20_000, 4))).astype(np.int64)
    lists = threshold_search.SortedLists(rows)
    for q in rows[:20]:
        places, scores, seen = lists.top(q, 6)
        want = np.lexsort((np.arange(len(rows)), -(rows @ q)))[:6]
        assert list(places) == list(want) and list(scores) == list((rows @ q)[want])
        assert seen < len(rows) / 4


def test_inertia_counts_and_eigenpairs():
    rng = np.random.default_rng(7)
    for d in (1, 2, 3, 10, 40):
        a = rng.normal(size=(d, d))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in rng.normal(0, 3, 20):
            assert whitening.count_above(a, shift) == int((values > shift).sum())
        v = a @ a.T
        values, vectors = np.linalg.eigh(v)
        for j, (e, x) in enumerate(whitening.leading_eigenpairs(v, 4)):
            assert abs(e - values[-1 - j]) <= 1e-12 * values[-1]
            assert abs(abs(x @ vectors[:, -1 - j]) - 1) < 1e-9


def test_eigenpairs_of_equal_and_close_values():
    q, _ = np.linalg.qr(np.random.default_rng(9).normal(size=(8, 8)))
    for values in ([5, 5, 5, 1, 1, 0, 0, 0], [4, 4 - 1e-9, 3, 2, 1, 1, 1, 1], [2] * 8, [1, 0, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, -1, -2, -3]):
        v = (q * np.array(values, dtype=float)) @ q.T
        v = (v + v.T) / 2
        pairs = whitening.leading_eigenpairs(v, 4)
        assert np.allclose([e for e, _ in pairs], sorted(values, reverse=True)[:4], atol=1e-10)
        x = np.array([x for _, x in pairs])
        assert np.allclose(x @ x.T, np.eye(4), atol=1e-10)
        assert max(np.linalg.norm(v @ y - e * y) for e, y in pairs) < 1e-8


def whitened(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    e, v = np.linalg.eigh(z.T @ z / n)
    return n, s, e[::-1], v[:, ::-1]


def test_whitening_equals_dense_solution(spark):
    rng = np.random.default_rng(11)
    data = rng.normal(0, 0.3, (300, 7)) * np.array([3, 2, 1.5, 1, 0.5, 0.4, 0.3]) + 0.7
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(data)]
    rows += [(1000 + i, rows[3][1]) for i in range(100)] + [(None, rows[4][1]), (7, None), (8, [None] * 7), (9, [float("inf")] * 7), (11, [0.5] * 3)]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], VECTORS).repartition(5)
    kept = [(i, np.floor(256 * np.array(v, dtype=float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == 7 and all(c is not None and math.isfinite(c) for c in v)]
    n, s, e, v = whitened(np.array([x for _, x in kept]))
    got = whitening.whiten(df).collect()
    assert len(got) == 4 * len(kept)
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10
    by = {(r.vec_id, r.component): r for r in got}
    sign = {}
    for i, x in kept:
        for j in range(4):
            r, want = by[(i, j + 1)], float((x - s / n) @ v[:, j] / math.sqrt(e[j]))
            sign.setdefault(j, 1 if abs(r.whitened - want) < abs(r.whitened + want) else -1)
            assert abs(r.whitened - sign[j] * want) < 1e-9
            assert r.deviation == int(((n * x - s) ** 2).sum()) and abs(r.explained - e[j] / e.sum()) < 1e-12


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1, "s") for i, v in rows], VECTORS)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [0.5, 0.5])] * 4)).count() == 0  # no variance
    line = whitening.whiten(make([(i, [0.1 * i, 0.2 * i]) for i in range(9)] + [(90, None)])).collect()
    assert {r.component for r in line} <= {1, 2} and len([r for r in line if r.component == 1]) == 9
    flat = whitening.whiten(make([(i, [0.5 * i, 0.25]) for i in range(4)])).collect()
    assert {r.component for r in flat} == {1}
    huge = whitening.whiten(make([(i, [2.0**40 * i, 2.0**39 * (i % 3)]) for i in range(6)])).collect()
    assert len(huge) == 12 and max(r.identity_error for r in huge) < 1e-9 and any(r.deviation is None for r in huge)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute_ranks(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * total) // length
            score = sum(math.floor(1000 * math.log((2.0 * total + 2) / (2.0 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_terms_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(ranked_search, "_SLICE", 16)
    for text in ("", "a" * 100, "Ab-c " * 30, "x" * 15 + " " + "y" * 16 + " z", "é" * 40 + "!" + "Ünï " * 9, " " * 50 + "end"):
        assert [t.decode() for part in ranked_search.term_slices(text.encode()) for t in part] == terms(text)


@pytest.mark.parametrize("size", [1 << 13, 9])
def test_ranks_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(ranked_search, "DOCS", size)
    monkeypatch.setattr(ranked_search.block_index, "__defaults__", (size,))
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "ÀB", "x1"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (1 + i) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(150)]
    docs += [(500 + i, docs[3][1]) for i in range(30)] + [(7, docs[7][1]), (600, None), (601, ""), (602, "--- ..."), (None, "w0 W1 w2"), (603, "w5 " * 3000), (604, "été")]
    items = [(i, text(rng.randint(1, 12))) for i in range(15)] + [(1, "w0 w0 W0"), (1, "w0 w0 W0"), (50, None), (51, ""), (52, "unknown words"), (53, "Été ÀB"), (54, "w1,w1;w2"), (1, "other w3")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, score string").repartition(4)
    b = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, key string")
    got = sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.rank_documents(d, b, k=10).collect()], key=str)
    assert got == brute_ranks(docs, items, 10)
    monkeypatch.setattr(ranked_search, "TERMS", 10)  # several blocks of queries
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.rank_documents(d, b, k=10).collect()], key=str) == got


def test_ranks_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ranked_search.rank_documents(d, b).count() == 0
    assert ranked_search.rank_documents(one, b.where("false")).count() == 0
    # A term that every document holds weighs floor(1000 ln(4/3)).
    assert [tuple(r) for r in ranked_search.rank_documents(one, b).collect()] == [(1, 1, 1, 2 * 287 * (10**9 // 1800))]


def test_pair_bounds_skip_what_single_bounds_cannot():
    """Two common terms that never meet: together they can't reach the threshold, though their sum could."""
    a = (np.arange(0, 50), np.full(50, 60, dtype=np.int64), 60)
    b = (np.arange(50, 100), np.full(50, 60, dtype=np.int64), 60)
    c = (np.array([10, 60]), np.array([100, 90], dtype=np.int64), 100)
    assert ranked_search.prefix_bounds([60, 60, 100], [60, 160]) == [0, 60, 60, 160]
    found, scores, walked = ranked_search.best_in_block([a, b, c], [60, 160], 100, 2, 100)
    assert list(found) == [10, 60] and list(scores) == [160, 150]
    _, _, plain = ranked_search.best_in_block([a, b, c], [120, 160], 100, 2, 100)
    assert walked < plain
