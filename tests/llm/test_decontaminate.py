import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.llm import decontaminate as D


def brute_tiles(doc, item, width):
    """Greedy string tiling by definition: longest match of unmarked words first; earliest item place, then text place."""
    md, mi, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for p in range(len(item)):
            for a in range(len(doc)):
                n = 0
                while p + n < len(item) and a + n < len(doc) and doc[a + n] == item[p + n] and not md[a + n] and not mi[p + n]:
                    n += 1
                if n >= width and (best is None or n > best[2]):
                    best = (a, p, n)
        if best is None:
            return tiles
        tiles.append(best)
        for k in range(best[2]):
            md[best[0] + k] = mi[best[1] + k] = True


@pytest.mark.parametrize("seed", range(40))
def test_tiles_against_definition(seed):
    rng = random.Random(seed)
    item = rng.choices("abcdef"[: rng.randint(2, 6)], k=25)
    doc = rng.choices("abcdef", k=10) + item[12:] + rng.choices("xyz", k=3) + item[:12] + rng.choices("abcdef", k=10)
    at, place = [], []
    for a in range(len(doc) - 4):
        for p in range(len(item) - 4):
            if doc[a : a + 5] == item[p : p + 5]:
                at.append(a)
                place.append(p)
    got = D.greedy_tiles(np.array(at), np.array(place), 5)
    assert sorted(got) == sorted(brute_tiles(doc, item, 5))


ITEM = [f"q{i}" for i in range(40)]


def tables(spark):
    turned = ITEM[25:] + ["and", "then"] + ITEM[10:25] + ["so"] + ITEM[:10]
    texts = {1: "intro " + " ".join(ITEM) + " end", 2: " ".join(turned).upper() + "!", 3: " ".join(ITEM[:20]), 4: "nothing here", 5: None, 6: "", 7: "; ".join(ITEM), 8: " ".join(reversed(ITEM)), 9: "q1 q2 q3 " * 3000, 10: "It is too short, no?", 11: "na " * 4000, 12: "one whole other text of this item"}
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(10, " ".join(ITEM)), (11, "too short"), (None, "a b c d e f"), (12, None), (12, " "), (13, "na " * 500), (14, " ".join(ITEM[20:]) + " and more words"), (14, "one whole other text of this item"), (14, "one whole other text of this item")], "item_id long, text string")
    return docs, bench


@pytest.mark.parametrize("limit, matches", [(D.BROADCAST_WORDS, D.MATCHES), (D.BROADCAST_WORDS, 1000), (0, D.MATCHES)])
def test_leaks_by_both_paths(spark, monkeypatch, limit, matches):
    monkeypatch.setattr(D, "MATCHES", matches)
    docs, bench = tables(spark)
    got = {r.doc_id: r for r in D.find_leaks(docs, bench, broadcast_words=limit).collect()}
    assert {d: r.item_ids for d, r in got.items() if r.contaminated} == {1: [10, 14], 2: [10, 14], 7: [10, 14], 10: [11], 11: [13], 12: [14]}
    assert got[3].max_coverage == 0.5 and got[5].max_coverage == 0.0 and len(got) == 12
    kept = D.drop_leaks(docs, bench, broadcast_words=limit)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 8, 9}


def test_items_and_documents_with_text_ids(spark):
    docs, bench = tables(spark)
    docs = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    bench = bench.select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("item_id"), "text")
    got = {r.doc_id: r.item_ids for r in D.find_leaks(docs, bench).collect() if r.contaminated}
    assert got == {"d1": ["i10", "i14"], "d2": ["i10", "i14"], "d7": ["i10", "i14"], "d10": ["i11"], "d11": ["i13"], "d12": ["i14"]}


def test_repeated_ids_and_rows(spark):
    docs = spark.createDataFrame([(1, " ".join(ITEM)), (1, "clean"), (1, " ".join(ITEM)), (None, " ".join(ITEM)), ((1 << 53) + 1, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(ITEM))], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_items) for r in D.find_leaks(docs, bench).collect())
    assert got == [("1", 0), ("1", 1), ("1", 1), (str((1 << 53) + 1), 0), ("None", 1)]


def test_empty_tables(spark):
    docs, bench = tables(spark)
    assert not any(r.contaminated for r in D.find_leaks(docs, bench.limit(0)).collect())
    assert D.find_leaks(docs.limit(0), bench).count() == 0


def test_whole_query_against_tiling_by_definition(spark):
    from barsmith.llm import queries

    sf = "/root/testdata/sf0.001"
    words = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        doc = words(r.text)
        want[r.doc_id] = 0
        places = {}
        for a in range(len(doc) - 4):
            places.setdefault(tuple(doc[a : a + 5]), []).append(a)
        for _, item in items:
            pairs = [(a, p) for p in range(len(item) - 4) for a in places.get(tuple(item[p : p + 5]), [])]
            if pairs:
                # Only the part of the document around the matches, for the slow definition.
                low, high = max(0, min(a for a, _ in pairs) - 1), max(a for a, _ in pairs) + 7
                near = doc[low:high] if high - low < 400 else None
                found = brute_tiles(near, item, 5) if near is not None else D.greedy_tiles(np.array([a for a, _ in pairs]), np.array([p for _, p in pairs]), 5)
                want[r.doc_id] += sum(t[2] for t in found) / len(item) >= D.COVERAGE
    got = {r.doc_id: r.n_items for r in queries.op5_decontamination(spark, sf).collect()}
    assert got == want and sum(want.values()) > 0
