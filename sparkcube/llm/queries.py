"""Queries over whole tables, one per operator: the operator with production parameters, and the digest columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcube.llm import decontamination, language_id, line_dedup, near_dedup, ngram_lm, packing, quality_rules, sharding, token_counts, url_filters


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(_read(spark, sf_dir, "documents"))
    digest = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*digest, "rule_failed", F.round("host_rate", 6).alias("host_rate"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def _id_remainder(of: int) -> Column:
    """crc32 of the doc_id as text, modulo; a null doc_id has remainder 0."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % of, F.lit(0))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = ngram_lm.train(docs.where(_id_remainder(7) != 2))
    found = ngram_lm.score(docs, model).withColumn("held_out", _id_remainder(7) == 2)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(_id_remainder(3) != 1))
    found = language_id.predict(docs.select("doc_id", "text"), model).withColumn("held_out", _id_remainder(3) == 1)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), k=3, percent=85)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_equal", "n_near", F.md5("text").alias("text_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_language_id": op7_language_id,
    "op8_url_filters": op8_url_filters,
    "op9_near_dedup": op9_near_dedup,
    "op10_line_dedup": op10_line_dedup,
}
