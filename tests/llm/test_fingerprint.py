import hashlib
import re
import struct


import xxhash
from pyspark.sql import functions as F


from barsmith.llm import multiset_fingerprint as P
from barsmith.llm import queries


def vec(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: tuple(r.vector) for r in P.fingerprints(df).collect()}


def test_order_of_paragraphs_and_updates(spark):
    a, b, c = "one two three four", "five six seven", "eight nine ten eleven twelve"
    v = vec(spark, [f"{a}\n{b}\n{c}", f"{c}\n\n{a}\n{b}", f"{a}\n{b}", c, f"{a} {b}\n{c}", "", None, f"{a}\n{b}\n{c}\n{c}"])
    assert v[0] == v[1] and v[0] != v[4] and v[0] != v[7] and v[5] == v[6] == tuple([0] * 69)
    df = spark.createDataFrame([(list(v[2]), list(v[3]), list(v[0]))], "a array<long>, c array<long>, s array<long>")
    row = df.select(P.add(F.col("a"), F.col("c")).alias("sum"), P.subtract(F.col("s"), F.col("c")).alias("rest"), P.subtract(F.col("a"), F.col("s")).alias("back")).first()
    assert tuple(row["sum"]) == v[0] and tuple(row.rest) == v[2] and all(x >= 0 for x in row.back)


def test_edited_texts(spark):
    texts = {3: "abcdefg", 1: "é" * 9 + "\nzz", 7: "", 9: None, 12: "日本語 text here", 20: "x", 21: "one two three four five six " * 400, 22: "one two three four five six " * 400}
    df = spark.createDataFrame([(k, t, "e") for k, t in texts.items()], "doc_id long, text string, vector string").repartition(3)
    got = {r.doc_id: r for r in P.edited_fingerprints(df).select("*", P.likeness(F.col("vector"), F.col("edited_vector")).alias("e"), P.likeness(F.col("vector"), F.col("next_vector")).alias("n")).collect()}
    order = sorted(texts)
    for i, d in enumerate(order):
        own, nxt = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(own) // 2
        want = own[: len(own) - half] + nxt[:half]
        assert got[d].n_chars == len(own) and got[d].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= got[d].e <= 1 and 0 <= got[d].n <= 1
    assert got[21].n == 1.0 and got[21].vector == got[22].vector and got[7].n == 1.0


def test_repeated_rows_null_ids_and_one_row(spark):
    df = spark.createDataFrame([(1, "aaaa"), (1, "aaaa"), (1, "bbbb"), (None, "cccc")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.edited_sha256) for r in P.edited_fingerprints(df).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # Order: null, then the two texts of 1 by their hash.
    a, b = sorted(["aaaa", "bbbb"], key=lambda t: hashlib.md5(t.encode()).hexdigest())
    each = {a: sha(a[:2] + b[:2]), b: sha(b[:2] + "cc")}
    assert got == sorted([("1", each["aaaa"]), ("1", each["aaaa"]), ("1", each["bbbb"]), ("None", sha("cc" + a[:2]))])
    one = P.edited_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == sha("abab")
    assert P.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeness_follows_the_shared_part(spark):
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words), *[" ".join(words[: 2000 - cut] + [f"z{i}" for i in range(cut)]) for cut in (200, 1000, 2000)]]
    v = vec(spark, texts)
    df = spark.createDataFrame([(i, list(v[0]), list(v[i])) for i in (1, 2, 3)], "i int, a array<long>, b array<long>")
    near = {r.i: r.n for r in df.select("i", P.likeness(F.col("a"), F.col("b")).alias("n")).collect()}
    assert near[1] > 0.75 > near[2] > 0.25 > near[3]


def vector_by_definition(text):
    """Sum of the paragraph vectors, lane by lane."""
    n, own, bits = 0, [0] * 4, [0] * 64
    for line in (text or "").split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not words:
            continue
        first = xxhash.xxh64_intdigest(line, seed=42)
        for k in (1, 2):
            h = xxhash.xxh64_intdigest(struct.pack("<i", k), seed=first)
            own[2 * k - 2] += h & 0xFFFFFFFF
            own[2 * k - 1] += h >> 32
        for run in [words[i : i + 3] for i in range(max(1, len(words) - 2))]:
            h, n = xxhash.xxh64_intdigest(" ".join(run), seed=42), n + 1
            for b in range(64):
                bits[b] += h >> b & 1
    return [n % 2**32, *[x % 2**32 for x in own], *[x % 2**16 for x in bits]]


def likeness_by_definition(a, b):
    if a == b:
        return 1.0
    sides = [[(2 * c - v[0] + 2**15) % 2**16 - 2**15 for c in v[5:]] for v in (a, b)]
    total, apart = sum(x * x for s in sides for x in s), sum((x - y) ** 2 for x, y in zip(*sides, strict=True))
    return 0.0 if total == 0 else min(1.0, max(0.0, 1 - apart / total))


def test_whole_query_against_definition(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(texts)
    own = {d: vector_by_definition(texts[d]) for d in order}
    got = {r.doc_id: r for r in queries.op7_fingerprints(spark, sf).collect()}
    assert sorted(got) == order
    for i, d in enumerate(order):
        follows, half = order[(i + 1) % len(order)], len(texts[d]) // 2
        text = texts[d][: len(texts[d]) - half] + texts[follows][:half]
        edited = vector_by_definition(text)
        digits = ["".join(f"{x:08x}" for x in v[:5]) + "".join(f"{x:04x}" for x in v[5:]) for v in (own[d], edited)]
        assert [got[d].fingerprint, got[d].edited_fingerprint] == digits and got[d].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert abs(got[d].near_edited - likeness_by_definition(own[d], edited)) < 1e-9 and abs(got[d].near_next - likeness_by_definition(own[d], own[follows])) < 1e-9
