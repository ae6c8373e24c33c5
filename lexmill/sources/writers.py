"""Sinks: corpora and topic tables as Parquet or tab-separated text, and manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_corpus(docs: DataFrame, path: str, settings: dict | None = None) -> None:
    """Documents and the settings that made them."""
    docs.write.mode("overwrite").parquet(f"{path}/documents")
    docs.sparkSession.createDataFrame([(json.dumps(settings or {}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/documents"), json.loads(spark.read.text(f"{path}/settings").first()["value"])


def write_topic_words(phi: DataFrame, path: str) -> None:
    """topic, word, p by topic and falling p."""
    phi.select("topic", "word", "p").orderBy("topic", F.desc("p"), "word").write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def write_doc_topics(theta: DataFrame, path: str, topics: list) -> None:
    """A line a document: its id and a share for each topic."""
    wide = theta.groupBy("doc_id").pivot("topic", topics).agg(F.first("p"))
    wide.write.mode("overwrite").option("sep", "\t").csv(path)


def save_state(assigned: DataFrame, path: str) -> None:
    """Token assignments (doc_id, pos, word, topic)."""
    assigned.select("doc_id", "pos", "word", "topic").write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A saved state's assignments, with the counts that they make: (topic, word, n) and (doc_id, topic, n)."""
    rows = spark.read.parquet(path)
    return rows, rows.groupBy("topic", "word").agg(F.count("*").alias("n")), rows.groupBy("doc_id", "topic").agg(F.count("*").alias("n"))


def save_embeddings(vectors: DataFrame, path: str, id_col: str = "doc_id", vec_col: str = "embedding") -> None:
    vectors.select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("embedding")).write.mode("overwrite").parquet(path)


def fingerprint(df: DataFrame, *columns: str) -> str:
    """A digest of rows whatever their order: a sum of row hashes, and their count."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*(columns or df.columns)).cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(f"{row['n']}:{row['h']}".encode()).hexdigest()


def manifest(spark: SparkSession, model_settings: dict, corpus: DataFrame, path: str, **extra) -> dict:
    """Records how a model was fitted, with a digest of the corpus, and writes it as JSON."""
    record = {"settings": model_settings, "corpus": fingerprint(corpus), "spark": spark.version, **extra}
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return record


def verify(spark: SparkSession, path: str, corpus: DataFrame) -> bool:
    return json.loads(spark.read.text(path).first()["value"])["corpus"] == fingerprint(corpus)
