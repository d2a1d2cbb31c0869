"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauselake.llm import (bpe_stream, html_text, language_id, mix_sources, near_dup, periodic_runs, quality, quality_rules, substring_dedup,
                            token_counts, topk_search, toxicity, vector_codes)
from clauselake.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(_table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(_table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.taken(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(_table(spark, sf_dir, "pages"))


def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(_table(spark, sf_dir, "documents"))


def op10_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.code_digests(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_quality_classifier, op3_exact_topk, op4_token_counts, op5_mix_sources, op6_toxicity,
        op7_quality_rules, op8_html_text, op9_minhash_near_dup, op10_bpe_coding, op11_language_id,
        op12_periodic_runs, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring_dedup.ORACLE_SQL, "op3_exact_topk": topk_search.ORACLE_SQL,
            "op5_mix_sources": mix_sources.ORACLE_SQL, "op9_minhash_near_dup": near_dup.ORACLE_SQL}
