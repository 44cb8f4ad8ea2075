"""The registered queries of this subpackage, with SQL texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import alignment, bpe, decontaminate, filter_audit, html, licenses, neardup, quality, secrets, sharding, substring, suffix, toxicity as toxic
from netloom.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), tokenizer())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.document_classes(table(spark, sf_dir, "documents"), k=3, percent=85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return alignment.aligned(table(spark, sf_dir, "documents"), tokenizer(), path("piece_bpe_32k.model"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer() -> str:
    """Place of the public vocabulary file of the queries (a parameter of the operator)."""
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_bpe, op2_quality_rules, op3_html_extraction, op4_minhash_near_dedup, op5_toxicity, op6_benchmark_decontamination,
    op7_sharding, op8_secret_scans, op9_suffix_array_dedup, op10_substring_dedup, op11_cross_tokenizer_alignment,
    op12_license_scans, op13_filter_interaction_audit)}
ORACLES: dict[str, str] = {"op2_quality_rules": quality.oracle_sql(),
                           "op13_filter_interaction_audit": filter_audit.oracle_sql()}
