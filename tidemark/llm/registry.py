"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import automaton, jaccard, langid, licenses, mixing, negatives, phrases, pieces, quality, rules, search, suffix_array, toolcalls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.counted_links(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_digest(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.digest(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.digest(table(spark, sf_dir, "conversations"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.digest(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.digest(table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_language_id, op3_quality_rules, op4_suffix_array_dedup, op5_quality_classifier, op6_mix_sources, op7_sentencepiece, op8_tool_calls, op9_substring_dedup, op10_exact_topk, op11_hard_negatives, op12_license_scan, op13_phrases)}


def oracle_sql() -> dict[str, str]:
    return {"op6_mix_sources": mixing.ORACLE_SQL, "op8_tool_calls": toolcalls.ORACLE_SQL, "op10_exact_topk": search.ORACLE_SQL, "op11_hard_negatives": negatives.ORACLE_SQL, "op12_license_scan": licenses.ORACLE_SQL, "op13_phrases": phrases.ORACLE_SQL}
