"""The registered queries of this subpackage with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from askloom.llm import decontamination, exactdedup, jaccardjoin, linededup, merkle, packing, personal, quality, secrets, sharding, tokencounts, urlfilter, whitening
from askloom.llm.oracles import ORACLE_SQL  # noqa: F401  (read by the entry point)

WORD_VOCABULARY = "word_bpe_49k.json"
RANK_VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_TOKENS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find_items(spark, docs, table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path(WORD_VOCABULARY))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(spark, docs)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan_secrets(docs, public_tokenizers.path(RANK_VOCABULARY), public_tokenizers.PATTERN)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = tokencounts.count_tokens(docs, public_tokenizers.path(WORD_VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    report = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality.judge_documents(docs, report=report)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", *report, failed.alias("base_failed"), "kept")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(spark, table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(spark, table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.join_similar(spark, table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(spark, table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(spark, table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.find_copies(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_secrets": op4_secrets,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_personal_data": op7_personal_data,
    "op8_sharding": op8_sharding,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_exact_dedup": op13_exact_dedup,
}
