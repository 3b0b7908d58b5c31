"""The subpackage's queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packframe.llm import chat, fingerprints, line_dedup, mixing, near_dedup, ppm, search, sentencepiece, sharding, toxicity
from packframe.llm.common import read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op1_item_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.lm_score(read(spark, sf_dir, "documents"))


def op3_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(chat.swapped_pairs(read(spark, sf_dir, "conversations")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"), dropped="n_dropped").select("doc_id", "source", "n_dropped", "text")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(read(spark, sf_dir, "documents"))


def op8_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), ["source", "doc_id"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_fingerprints, op1_item_overlaps, op2_ppm_score, op3_chat_preferences, op4_near_dedup, op5_mix_sources, op6_line_dedup, op7_sentencepiece, op8_bm25_top_k, op9_shard, op10_toxicity)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_fingerprints": fingerprints.SQL, "op3_chat_preferences": chat.SQL, "op6_line_dedup": line_dedup.SQL, "op8_bm25_top_k": search.SQL}
