"""Registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import crosstokens, linededup, lmscore, media, mixing, ngramjoin, oracles, packing, quality, secretcrf, tokencounts, toxicity, turns, urlgraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.digest(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.digest(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.digest(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.digest(table(spark, sf_dir, "documents"))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretcrf.digest(table(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.digest(table(spark, sf_dir, "conversations"))


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstokens.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_url_filters": op2_url_filters,
        "op3_line_dedup": op3_line_dedup,
        "op4_media_columns": op4_media_columns,
        "op5_packing": op5_packing,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_source_mixing": op7_source_mixing,
        "op8_quality_rules": op8_quality_rules,
        "op9_toxicity": op9_toxicity,
        "op10_lm_scoring": op10_lm_scoring,
        "op11_secret_scans": op11_secret_scans,
        "op12_turn_repair": op12_turn_repair,
        "op13_cross_tokens": op13_cross_tokens,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": oracles.url_graph(),
        "op3_line_dedup": oracles.LINE_DEDUP,
        "op6_ngram_jaccard": oracles.NGRAM_JACCARD,
        "op7_source_mixing": oracles.MIXING,
        "op8_quality_rules": oracles.quality_rules(),
        "op12_turn_repair": oracles.TURN_REPAIR,
    }
