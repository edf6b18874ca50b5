import hashlib
import random
import re
from collections import Counter

import pytest

from barsmith.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize(("window", "gram", "batches"), [(35, 8, 2), (7, 3, 4), (5, 5, 1)])
def test_against_brute_force(spark, window, gram, batches):
    rng = random.Random(window)
    vocab = [f"w{i}" for i in range(400)] + ["é", "日本", "A"]
    shared = [rng.choices(vocab, k=rng.choice([10, 36, 50, 90])) for _ in range(12)]
    rows = []
    for i in range(150):
        w = rng.choices(vocab, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w = w[:at] + rng.choice(shared) + w[at:]
        rows.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    rows += [(500, "a " * 50), (501, "b " * 36), (502, "c " * 35), (503, None), (504, ""), (505, " \n"), (506, rows[3][1]), (3, rows[3][1]), (507, "x y " + " ".join(shared[0]))]
    rows += [(600, " ".join(["p", "q", "r"] * 40)), (None, " ".join(shared[1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(S.remove_repeats(df, window=window, gram=gram, batches=batches)) == brute(rows, window)


def test_kept_text_and_extra_columns(spark):
    passage = " ".join(f"s{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"start {passage} end", "k"), (2, f"{passage} tail", "h")], "doc_id long, text string, k string")
    assert {r.doc_id: r.kept for r in S.remove_repeats(df).collect()} == {1: "start end", 2: "tail"}


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_keeps_runs_and_compacts(spark):
    index = S.WindowIndex(spark, fan=2)
    keyed = [spark.createDataFrame([(i, " ".join(f"v{j}" for j in range(lo, lo + 60)))], "k long, text string") for i, lo in enumerate((0, 1000, 10))]
    index.add(S.fingerprints(keyed[0]))
    assert index.repeated().count() == 0
    index.add(S.fingerprints(keyed[1]))
    assert len(index.runs) == 1 and index.repeated().count() == 0  # two runs were merged into one
    name = index.add(S.fingerprints(keyed[2]))
    assert index.repeated().count() > 0
    assert spark.table(index.runs[0]).where("n > 1").count() > 0 and name not in index.runs


def test_windows_of_earlier_calls_count(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    shared = [rng.choices(vocab, k=rng.choice([7, 9, 20])) for _ in range(15)]
    calls = []
    for c in range(2):
        rows = []
        for i in range(25):
            w = rng.choices(vocab, k=rng.randint(0, 30))
            at = rng.randint(0, len(w))
            rows.append((100 * c + i, " ".join(w[:at] + rng.choice(shared) + w[at:])))
        calls.append(rows)
    calls[1].append(calls[0][3])  # the same row again
    index, before = S.WindowIndex(spark, buckets=4), []
    for rows in calls:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        now, want = got(S.remove_repeats(df, window=7, gram=3, index=index)), brute([*before, *rows], 7)
        assert all(r in want for r in now) and len(now) == len(rows)
        assert not before or now != brute(rows, 7)
        before += rows
    with pytest.raises(ValueError):
        S.remove_repeats(df, index=index)
