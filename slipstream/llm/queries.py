"""The operators as named queries with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slipstream.llm import decontaminate, html_text, license_scan, lm_scoring, manifest, near_dedup, packing, quality, quality_classifier, repeats, search, secret_scan, toxicity
from slipstream.llm.common import table
from slipstream.llm.oracles import ORACLES


def op1_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_equivalence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_conditional_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op7_prefix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op8_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op9_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_bitmap_rank_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.merkle_manifest(table(spark, sf_dir, "documents"))


def op12_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_length_strata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_entropy_difference": op1_entropy_difference,
    "op2_suffix_automaton": op2_suffix_automaton,
    "op3_equivalence_classes": op3_equivalence_classes,
    "op4_super_minhash": op4_super_minhash,
    "op5_weak_supervision": op5_weak_supervision,
    "op6_conditional_compression": op6_conditional_compression,
    "op7_prefix_intervals": op7_prefix_intervals,
    "op8_token_efficiency": op8_token_efficiency,
    "op9_recurrent_toxicity": op9_recurrent_toxicity,
    "op10_variable_best_fit": op10_variable_best_fit,
    "op11_bitmap_rank_manifest": op11_bitmap_rank_manifest,
    "op12_attention_quality": op12_attention_quality,
    "op13_length_strata_search": op13_length_strata_search,
}

__all__ = ["ORACLES", "QUERIES"]
