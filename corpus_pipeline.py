"""The corpus pipeline: documents go through language ID, line dedup, MinHash near-dedup and packing.

Each stage takes what its predecessor kept, is written as Parquet and read again by the next. All but the last return
the columns of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import langid, line_dedup, near_dup_text, packing
from lexmill.llm.common import scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a learned language is found; those without letters, or with no language in the lead, go.

    Null and empty texts go. Rows that repeat are judged alike; ids may be null or repeat; columns of any name stay as
    they are, also lang_pred. Texts of any length are read whole. No rows: no rows.
    """
    return langid.reject_unknown(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines of three-line windows that occurred before; those that lose all go.

    Texts that are null, empty or of fewer than three lines stay as they are. Of equal windows that of the least
    (doc_id, line) stays; rows with a null id lose nothing; rows that repeat id and text share their places. Columns of
    any name stay; n_chars follows the text. No rows: no rows.
    """
    return line_dedup.drop_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, at five words and 0.8.

    The least doc_id stays, then the least hash of the text; of rows that repeat both, any one. Texts without words
    (null, empty, blank) are no copies of one another and stay; texts of fewer than five words are one shingle. Columns
    of any name stay as they are. No rows: no rows.
    """
    return near_dup_text.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are one end token; rows that repeat are packed once each; ids may be null. Ties of scores go to the
    earlier document of the shard. No rows: no rows.
    """
    return packing.op8(docs)


STAGES = [("language_id", language_id), ("line_dedup", repeated_lines), ("minhash_near_dedup", near_duplicates), ("packing", packed)]

#: Training and tokenising aren't SQL: the tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next one reads it."""
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
