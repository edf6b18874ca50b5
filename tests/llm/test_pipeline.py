import re

import corpus_pipeline as P
from pyspark.sql import functions as F

from barsmith.llm import decontaminate, secret_ledger, toxicity
from barsmith.llm.common import batch_word_hashes, with_global_rank, word_hashes

SF = "/root/testdata/sf0.001"


def kept_by_definition(rows):
    """The smallest id of each group of texts whose sets of five-word shingles (A-Z in lower case) are alike to 0.8, by comparing all pairs."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return {min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}


def test_stages_take_effect_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    now = docs
    for name, stage in P.STAGES[:-1]:
        before, now = now, stage(spark, now, SF).cache()
        assert now.columns == docs.columns
        ids = {r.doc_id for r in now.collect()}
        if name == "toxicity":
            assert ids == {r.doc_id for r in toxicity.score_toxicity(before, labels).where("predicted = 0").collect()}
        elif name == "near_duplicates":
            assert ids == kept_by_definition([(r.doc_id, r.text) for r in before.collect()])
        elif name == "decontamination":
            assert ids == {r.doc_id for r in decontaminate.find_leaks(before, bench).where("not contaminated").collect()}
        else:
            assert ids == {r.doc_id for r in before.collect()}
            assert all(not secret_ledger.find_spans(r.text) for r in now.collect())
            assert now.where(F.char_length("text") != F.col("n_chars")).count() == 0
    out = P.run(spark, SF).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in now.collect()} and all(r.taken <= 3 * r.size for r in out)


def test_stages_handle_empty_and_null_rows(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, None), (2, "", None, "a", 0), (2, "", None, "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (odd, odd.limit(0)):
        now = rows
        for _, stage in P.STAGES:
            now = stage(spark, now, SF).cache()
            now.count()


def test_ranks_are_a_total_order(spark):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5003).alias("v"))
    got = [r.v for r in with_global_rank(df, ["v"]).orderBy("rank").collect()]
    assert got == sorted(got) and with_global_rank(df, ["v"]).agg(F.max("rank")).first()[0] == 4999


def test_word_hashes_agree_however_words_are_cut():
    import pyarrow as pa
    import numpy as np

    texts = ["a b  c", "", None, "\té x\n", "c b a " * 100_000, "z" * 3_000_000, " ", "b", "a b  c"]
    h, begin = batch_word_hashes(pa.array(texts))
    for i, t in enumerate(texts):
        want = [int(word_hashes(np.frombuffer(w, np.uint8))[0]) for w in (t or "").encode().split()[:50]]
        assert [int(x) for x in h[begin[i] : begin[i + 1]][:50]] == want and begin[i + 1] - begin[i] == len((t or "").split())
