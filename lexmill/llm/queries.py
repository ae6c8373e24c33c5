"""The thin queries opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.lineage import spread
from . import chat, divergence, fim, langid, licenses, line_dedup, near_dup_text, near_dup_vectors, packing, pieces, rollups, token_files, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op1(table(spark, sf_dir, "embeddings"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op2(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op3(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op4(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op5(table(spark, sf_dir, "conversations"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_text.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_vectors.op7(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op8(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op10(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.op11(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op12(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.op13(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_exact_top_k, op2_sentencepiece, op3_license_scan, op4_language_id, op5_chat_format, op6_minhash_near_dedup,
    op7_embedding_near_dedup, op8_packing, op9_token_counts, op10_line_dedup, op11_fill_in_middle, op12_token_files, op13_source_divergence)}

ORACLES: dict[str, str] = {
    "op1_exact_top_k": topk.ORACLE,
    "op3_license_scan": licenses.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op7_embedding_near_dedup": near_dup_vectors.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
