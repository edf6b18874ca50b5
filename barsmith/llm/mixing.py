"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target number of words. Complete epochs of a source come
first; what is left of its target is filled by weighted sampling without
replacement: each document draws the exponential key -ln(u) / w, with u from a
hash of its id and w its quality weight, and documents are taken by ascending
key until their sizes, summed in that order, reach the rest.

Keys are dealt to buckets in key order, so the order within a source is never
sorted as a whole: sums of buckets tell which bucket holds the end, and only
rows of that bucket are ranked. Buckets hold about as many rows each, whatever
the weights: a key's bucket is its share of the source's own distribution of
keys, which follows from how often each weight stands in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, word_count

CAP = 3
ROWS_PER_BUCKET, LEAST_BUCKETS = 5_000, 64
#: Steps, each half as much again, to which weights are rounded for the distribution of keys.
STEP, STEPS = 1.5, 24
#: Sources up to this number are broadcast (one short row each).
BROADCAST_SOURCES = 50_000


def quality_weight(text: Column) -> Column:
    """Squared share of characters that aren't one of ``!#$%&*|``, 0.05 at least; 1 for an empty text."""
    text = F.coalesce(text, F.lit(""))
    share = F.char_length(F.translate(text, "!#$%&*|", "")).cast("double") / F.greatest(F.char_length(text), F.lit(1)).cast("double")
    return F.when(F.char_length(text) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), share * share))


def unit_draw(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) from the id, the same in every run: 48 bits of an md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    value = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double")
    return (value + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets of sources (columns source, source_size): they share all words by weight, up to CAP times their size.

    Sources in code point order, null last, take the weights in turn. The
    excess of a source at its cap goes to the others by weight. Sorted by
    cap / weight, sources reach their caps in order, so the level at which the
    rest share is found by running sums instead of repeated passes.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    weighed = weighed.withColumn("_cap", F.col("source_size").cast("double") * CAP).withColumn("_r", F.col("_cap") / F.col("_w"))
    rank = Window.orderBy("_r", F.col("source").asc_nulls_last())
    before, whole = rank.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum(F.col("source_size").cast("double")).over(whole)
    rest = total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    share = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    levels = weighed.withColumn("_level", rest / share)
    return levels.select("source", "source_size", *[c for c in sizes.columns if c not in ("source", "source_size")], F.least(F.col("_cap"), F.col("_w") * F.max("_level").over(whole)).alias("target"))


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weight: Callable[[Column], Column] = quality_weight, weights: tuple[int, ...] = (1, 2, 3), seed: int = 42) -> DataFrame:
    """How many words the mix takes of each row: id, size, source, source_size, target, taken.

    One row per input row. A null source is a source of its own, the last. Null
    and empty texts have size 0 and are taken as 0 words. Ties in the key go by
    id and then size; repeated rows draw the same key and are taken one by one.
    ``taken`` is a multiple of the size: whole epochs, and one more for sampled
    documents; the last sampled one is taken if at least half of it fits. An
    empty table gives no rows. Very long texts are counted whole; one larger
    than what is left of a target may be left out whole, so a source misses its
    target by less than its largest document. Weights must be positive.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), weight(F.col(text_col)).alias("_weight"))
    step = F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS), F.round(F.log(F.col("_weight")) / F.log(F.lit(STEP))))).cast("int")
    rows = rows.withColumns({"_key": -F.log(unit_draw(F.col("_id"), seed)) / F.col("_weight"), "_step": step}).drop("_weight")
    rows = materialize(rows, "mix")
    steps = rows.groupBy("source", "_step").agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_c"))
    # At most 2 STEPS + 1 pairs for each source.
    sizes = steps.groupBy("source").agg(F.sum("_sum").alias("source_size"), F.sum("_c").alias("_n"), F.sort_array(F.collect_list(F.struct("_step", "_c"))).alias("_steps"))
    targets = materialize(source_targets(sizes, weights).withColumn("_sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("_epochs", epochs).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    if targets.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    named = rows.withColumnRenamed("source", "_source").join(plan, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    buckets = F.greatest(F.lit(LEAST_BUCKETS), F.ceil(F.col("_n") / F.lit(ROWS_PER_BUCKET))).cast("double")
    below = F.aggregate("_steps", F.lit(0.0), lambda a, x: a + x["_c"].cast("double") * (1.0 - F.exp(-F.col("_key") * F.pow(F.lit(STEP), x["_step"])))) / F.col("_n")
    named = named.withColumn("_b", F.floor(buckets * below).cast("long")).drop("_steps", "_step")

    sums = named.groupBy("_sid", "_b").agg(F.sum("size").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("_sid").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    placed = named.join(sums.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_sum")), ["_sid", "_b"])
    split = (F.col("_before") < F.col("_rest")) & (F.col("_upto") > F.col("_rest"))
    whole = placed.where(~split).withColumn("_more", (F.col("_upto") <= F.col("_rest")).cast("long"))
    order = Window.partitionBy("_sid", "_b").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = F.col("_before") + F.sum("size").over(order)
    parted = placed.where(split).withColumn("_run", run).withColumn("_more", (F.col("_run") - F.col("size") / 2.0 <= F.col("_rest")).cast("long")).drop("_run")
    return whole.unionByName(parted).select(F.col("_id").alias(id_col), "size", "source", "source_size", "target", (F.col("size") * (F.col("_epochs") + F.col("_more"))).alias("taken"))


def mixed_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: ids with ``copies``, the number of times that each is to be read; ids taken 0 times are left out.

    Documents without words go with the mix once, so that filtering by size is left to its own stage.
    """
    taken = mix(docs, text_col, id_col, source_col, **options)
    copies = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(1)).cast("int")
    return taken.select(id_col, "size", "source_size", "target", "taken", copies.alias("copies")).where("copies > 0")


#: DuckDB SQL for the whole operator over a relation of columns doc_id, text, source.
def oracle(relation: str) -> str:
    return rf"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN length(coalesce(text, '')) = 0 THEN 1.0::DOUBLE ELSE greatest(0.05::DOUBLE,
      (length(translate(text, '!#$%&*|', ''))::DOUBLE / length(text)::DOUBLE) * (length(translate(text, '!#$%&*|', ''))::DOUBLE / length(text)::DOUBLE)) END AS w,
    (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM {relation}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS sw FROM sources),
levels AS (SELECT *, source_size::DOUBLE * 3 AS cap,
    (sum(source_size::DOUBLE) OVER () - coalesce(sum(source_size::DOUBLE * 3) OVER (ORDER BY source_size::DOUBLE * 3 / sw, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(sw) OVER () - coalesce(sum(sw) OVER (ORDER BY source_size::DOUBLE * 3 / sw, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
targets AS (SELECT source, source_size, least(cap, sw * max(level) OVER ()) AS target FROM levels),
planned AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
summed AS (SELECT r.doc_id, r.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY -ln(r.u) / r.w, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS run
  FROM rows_ r JOIN planned p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, round(target, 3) AS target, size * (epochs + CASE WHEN run - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS taken FROM summed
"""
