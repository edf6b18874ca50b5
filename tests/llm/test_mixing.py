import random

import duckdb
import pytest

from barsmith.llm import mixing as M


def water(sizes, weights):
    """Targets by repeated passes."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w >= 3 * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        i = min(over, key=lambda i: 3 * sizes[i] / weights[i])
        target[i] = 3.0 * sizes[i]
        left -= target[i]
        open_.discard(i)
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 10, 500, 10_000]) * rng.randint(1, 9) for _ in range(rng.randint(1, 9))]
    names = [None if i == len(sizes) - 1 and seed % 2 else f"s{i}" for i in range(len(sizes))]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    got = {r.source: r.target for r in M.source_targets(df).collect()}
    want = dict(zip(names, water(sizes, [i % 3 + 1.0 for i in range(len(sizes))]), strict=True))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def documents(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "a", "a", "a", "b", "c", None]), "extra") for i in range(600)]
    rows += [(5, "again again", "b", "x"), (5, "again again", "b", "x"), (None, "no id", "c", "x"), (700, None, "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(6)


def test_mix(spark):
    docs = documents(spark)
    rows = M.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, M.mix(docs).collect())) and len(rows) == docs.count()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert sum(r.size for r in own) == own[0].source_size
        assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in own)
        if own[0].target >= own[0].source_size:
            assert all(r.taken >= r.size for r in own)


def test_against_sql(spark):
    docs = documents(spark).select("doc_id", "text", "source")
    con = duckdb.connect()
    con.register("given", docs.toPandas().astype({"doc_id": "Int64"}))
    want = sorted(map(str, con.execute(M.oracle("given")).fetchall()))
    got = sorted(str((r.doc_id, r.size, r.source_size, round(r.target, 3), r.taken)) for r in M.mix(docs).collect())
    assert got == want


def test_heavier_weights_are_taken_more(spark):
    df = spark.createDataFrame([(i, "w w w w", "a") for i in range(900)] + [(2000 + i, "w w w w", "b") for i in range(300)], "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    got = M.mix(df, weights=(1, 2), weight=lambda t: F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).where("source = 'a'").collect()
    even, odd = (sum(r.taken for r in got if r.doc_id % 2 == k) for k in (0, 1))
    assert even > 1.5 * odd


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
