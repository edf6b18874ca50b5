"""Queries of the corpus operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_crf, mixing, multiset_fingerprint, page_diff, quality_qda, ranked_search, secret_ledger, substring_dedup, threshold_search, toxicity, whitening
from .common import read_table
from .simhash_dedup import near_components


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(read_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = page_diff.extract_main_text(read_table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multiset_fingerprint.edited_fingerprints(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        multiset_fingerprint.as_hex(F.col("vector")).alias("fingerprint"),
        multiset_fingerprint.as_hex(F.col("edited_vector")).alias("edited_fingerprint"),
        multiset_fingerprint.likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        multiset_fingerprint.likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.predict_language(read_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.SecretLedger(spark).scan(read_table(spark, sf_dir, "documents"))
    counts = [F.size(secret_ledger.of_kinds(F.col("spans"), (kind,))).cast("long").alias(f"n_{kind}") for kind in secret_ledger.BASE]
    base = secret_ledger.span_text(secret_ledger.of_kinds(F.col("spans"), secret_ledger.BASE))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_ledger.span_text(F.col("spans")).alias("spans"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.top_inner_products(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=4)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_mixing": op2_mixing,
        "op3_quality": op3_quality,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_decontamination": op5_decontamination,
        "op6_html_extraction": op6_html_extraction,
        "op7_fingerprints": op7_fingerprints,
        "op8_language_id": op8_language_id,
        "op9_secret_scan": op9_secret_scan,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_top_k_search": op11_top_k_search,
        "op12_whitening": op12_whitening,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.oracle("documents"),
        "op4_substring_dedup": substring_dedup.ORACLE,
        "op11_top_k_search": threshold_search.oracle(),
        "op13_lexical_search": ranked_search.oracle(),
    }
