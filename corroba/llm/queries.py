"""The registered queries of this package, one an operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corroba.llm import chat, exact_dedup, lang_id, mixing, near_dup, packing, quality, token_files, vp_search, warc
from corroba.llm.common import new_path, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path).drop("ids")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.capture_histories(table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr(f"cast({chat.PROBE_ID} as bigint) conv_id", "id turn", "case id when 0 then 'user' else 'assistant' end role").selectExpr("*", f"r'{chat.PROBE_TEXT}' text")
    return chat.digests(chat.format_conversations(turns.union(probe)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.predict_languages(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.nearest_neighbours(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_token_files": op3_token_files,
    "op4_warc": op4_warc,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality": op9_quality,
    "op10_vantage_point": op10_vantage_point,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": warc.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_chat_format": chat.ORACLE,
    "op10_vantage_point": vp_search.ORACLE,
}
