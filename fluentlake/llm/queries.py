"""The registered query of each operator, with production parameters, over its whole table; and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluentlake.llm import byte_bpe, exact_dedup, jaccard_join, license_scan, lm_scoring, quality_classifier, quality_rules, source_mixing, token_counts, toxicity
from fluentlake.llm.shared import documents

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_rules(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: documents lie in <source>/<hundreds of 500>/<of 50>/, every 25th is its directory's LICENSE."""
    name = F.when(F.col("doc_id") % 25 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.expr("cast(doc_id div 500 as string)"), F.when(F.col("doc_id") % 50 != 0, F.expr("cast(doc_id div 50 as string)")), name)
    files = documents(spark, sf_dir).select(path.alias("path"), "doc_id", "text")
    return license_scan.scan_licences(files, keep=("doc_id",))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_section_tokens(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir), n=3, percent=90)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_rules, op2_toxicity, op3_lm_scoring, op4_license_scan, op5_token_counts, op6_jaccard_join, op7_source_mixing, op8_exact_dedup, op9_byte_bpe, op10_quality_classifier)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard_join": jaccard_join.ORACLE_SQL, "op7_source_mixing": source_mixing.ORACLE_SQL, "op8_exact_dedup": exact_dedup.ORACLE_SQL}
