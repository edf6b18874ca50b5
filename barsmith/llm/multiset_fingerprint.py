"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame functions only.

Each paragraph (line with at least one word) is hashed to a wide vector of
whole numbers; the fingerprint of a document is the sum of these vectors modulo
powers of two. Hence equal multisets of paragraphs have equal fingerprints in
any order, and a paragraph is inserted or deleted by adding or subtracting its
vector. The vector of a paragraph holds

* its number of word shingles (modulo 2^32),
* 4 lanes of hash of the whole paragraph (modulo 2^32), which tell texts apart,
* 64 lanes that count the set bits of the hashes of its word shingles (modulo
  2^16): the difference of two such sums estimates how many shingles differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_global_rank, words
from .simhash_dedup import bit_sums, shingle_hashes

WIDTH = 3
LANES = 64
_LOW32 = 0xFFFFFFFF
_MODULI = [1 << 32] * 5 + [1 << 16] * LANES


def vectors(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Sum of the paragraph vectors of each row: the keys and ``vector``, an array of 69 longs.

    ``keys`` must name one row each. A null or empty text has the zero vector.
    Rows are counted inside their task before one row each is shuffled.
    """
    lines = rows.select(*keys, F.explode_outer(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_p"))
    lines = lines.select(*keys, F.xxhash64("_p", F.lit(1)).alias("_a"), F.xxhash64("_p", F.lit(2)).alias("_b"), words(F.col("_p")).alias("_w"))
    each = lines.select(*keys, "_a", "_b", F.posexplode_outer(shingle_hashes(F.col("_w"), WIDTH)).alias("_i", "_h"))
    first = F.col("_i") == 0
    halves = [F.col("_a").bitwiseAND(F.lit(_LOW32)), F.shiftrightunsigned("_a", 32), F.col("_b").bitwiseAND(F.lit(_LOW32)), F.shiftrightunsigned("_b", 32)]
    own = [F.sum(F.when(first, x).otherwise(F.lit(0))).alias(f"_q{k}") for k, x in enumerate(halves)]
    sums = each.groupBy(*keys).agg(F.count("_h").alias("_n"), *own, *bit_sums("_h"))
    low = [F.coalesce(F.col(f"_s{k}"), F.lit(0)).bitwiseAND(F.lit(_LOW32)) for k in range(32)]
    high = [F.shiftrightunsigned(F.coalesce(F.col(f"_s{k}"), F.lit(0)), 32) for k in range(32)]
    lanes = [F.col("_n"), *[F.col(f"_q{k}") for k in range(4)], *low, *high]
    return sums.select(*keys, F.array(*[x.bitwiseAND(F.lit(m - 1)) for x, m in zip(lanes, _MODULI, strict=True)]).alias("vector"))


def add(a: Column, b: Column) -> Column:
    """Vector of the union of two multisets of paragraphs."""
    return _combined(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """Vector of what is left of ``a`` when the paragraphs of ``b`` are taken out."""
    return _combined(a, b, -1)


def _combined(a: Column, b: Column, sign: int) -> Column:
    both = F.zip_with(a, b, lambda x, y: x + y if sign > 0 else x - y)
    return F.transform(both, lambda x, i: F.pmod(x, F.when(i < 5, F.lit(1 << 32)).otherwise(F.lit(1 << 16))))


def as_hex(vector: Column) -> Column:
    """The fingerprint as text: 8 hex digits for each of the first 5 lanes, 4 for each other."""
    digits = F.transform(vector, lambda x, i: F.lower(F.lpad(F.hex(x), F.when(i < 5, F.lit(8)).otherwise(F.lit(4)), F.lit("0"))))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column) -> Column:
    """Estimate of 2 <A, B> / (<A, A> + <B, B>) over the counts of shingles A and B of two vectors, cut to 0 to 1.

    Exactly 1 for equal vectors, so also for two without words. Lanes are read
    as signed differences, so the modulus matters only past 32,767 more set than unset bits.
    """
    def signed(x: Column) -> Column:
        # 2 * count - n, brought back to the range of the modulus.
        return F.transform(F.slice(x, 6, LANES), lambda c: F.pmod(2 * c - F.element_at(x, 1) + (1 << 15), F.lit(1 << 16)) - (1 << 15))

    def energy(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, d: s + (d * d).cast("double"))

    sa, sb = signed(a), signed(b)
    total = energy(sa) + energy(sb)
    apart = energy(F.zip_with(sa, sb, lambda x, y: x - y))
    return F.when(a == b, F.lit(1.0)).when(total <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - apart / total)))


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: the id and ``vector``; extra columns are ignored, null texts count as empty."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return vectors(rows, ["_row", "_id"], "_text").select(F.col("_id").alias(id_col), "vector")


def edited_fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprint of every text, and of its edited text, whose second half is the start of the next document.

    The last floor(n / 2) code points of a text are replaced by the first as
    many of the next document by ascending id (null first; ties by the text's
    hash; after the last document comes the first). Rows that repeat both id and
    text are one document in that order and give repeated results. Columns: id,
    n_chars, edited_sha256, vector, edited_vector, next_vector.

    An empty table gives no rows; the only document of a table is its own next.
    Very long texts are read whole. Ids keep their type; other columns are not
    read. The order is found over narrow rows. Texts are shuffled to meet their
    places, again as starts of the documents before, and once more to be joined
    with these.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_md5", F.md5(F.col("_text").cast("binary")))
    rows = rows.withColumn("_k", F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_id").isNull().cast("string"), "_md5"))
    narrow = rows.select("_id", "_md5", "_k", F.char_length("_text").cast("long").alias("_n"))
    ranks = with_global_rank(narrow.groupBy("_id", "_md5", "_k", "_n").agg(F.count(F.lit(1)).alias("_m")), ["_id", "_md5"], "_rank")
    n, repeats = ranks.agg(F.count(F.lit(1)), F.max("_m")).first()
    after = ranks.select(F.pmod(F.col("_rank") - 1, F.lit(max(n, 1))).alias("_rank"), F.col("_k").alias("_next"), F.col("_rank").alias("_next_rank"))
    pairs = ranks.select("_rank", "_id", "_k", "_n", "_m").join(after, "_rank")
    pairs = materialize(pairs, "pairs")

    need = pairs.select(F.col("_next").alias("_k"), F.col("_k").alias("_for"), F.expr("_n div 2").alias("_need"))
    heads = rows.select("_k", "_text").join(need.hint("shuffle_hash"), "_k").select("_for", F.expr("substring(_text, 1, int(_need))").alias("_head"))
    if (repeats or 0) > 1:
        heads = heads.dropDuplicates(["_for"])
    own = rows.select("_k", "_text").join(pairs.select("_k", "_rank", "_n").hint("shuffle_hash"), "_k")
    edited = own.join(heads, own._k == heads._for).select("_rank", "_text", F.expr("concat(substring(_text, 1, int(_n - _n div 2)), _head)").alias("_edited"))
    edited = edited.select("_rank", F.unhex(F.sha2(F.col("_edited").cast("binary"), 256)).alias("_sha"), "_text", "_edited")
    if (repeats or 0) > 1:
        # Rows that repeat id and text are one document here; how often it stands is joined back at the end.
        edited = edited.dropDuplicates(["_rank"])
    both = edited.select("_rank", "_sha", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("e"), F.col("_edited").alias("t")))).alias("_x"))
    both = both.select("_rank", "_sha", F.col("_x.e").alias("_e"), F.col("_x.t").alias("_t"))
    found = materialize(vectors(both, ["_rank", "_sha", "_e"], "_t"), "vectors")

    # Every row is named by its place in the order, which a task that runs again gives anew alike.
    plain = found.where("_e = 0").select("_rank", "vector")
    changed = found.where("_e = 1").select("_rank", "_sha", F.col("vector").alias("edited_vector"))
    following = plain.select(F.col("_rank").alias("_next_rank"), F.col("vector").alias("next_vector"))
    names = pairs.select("_rank", "_next_rank", "_id", "_n", "_m")
    if (repeats or 0) > 1:
        names = names.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))))
    out = plain.join(changed, "_rank").join(names, "_rank").join(following, "_next_rank")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_chars"), F.lower(F.hex("_sha")).alias("edited_sha256"), "vector", "edited_vector", "next_vector")
