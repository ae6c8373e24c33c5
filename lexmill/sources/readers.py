"""Sources of documents: (doc_id, name, label, text) tables from files, strings and token lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import vocabulary


def read_lines(spark: SparkSession, path: str, id_field: bool = False) -> DataFrame:
    """(doc_id, name, text): one document a line, trimmed, blank lines skipped; the first word is the name if asked, else doc_<n>.

    n counts the lines of one file in order. Lines are numbered by the reader's own block offsets, so only the few
    counts of partitions meet on the driver.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.trim("value").alias("text"))
    parts = lines.groupBy("file", "block", (F.col("seq").bitwiseAND(0) + F.shiftright("seq", 33)).alias("part")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("file", "block", "part", "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    j = lines.withColumn("part", F.shiftright("seq", 33)).join(F.broadcast(starts), ["file", "block", "part"])
    n = j.select((F.col("before") + F.col("seq") - F.col("first")).alias("doc_id"), "text").where("text <> ''")
    if id_field:
        return n.select("doc_id", F.substring_index("text", " ", 1).alias("name"), F.trim(F.expr("substring(text, instr(concat(text, ' '), ' '))")).alias("text"))
    return n.select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("name"), "text")


def read_tsv(spark: SparkSession, path: str, text_column: int = 2, id_column: int | None = 0, label_column: int | None = 1) -> DataFrame:
    """(name, label, text) of tab-separated lines without quoting; lines that are too short are skipped, a missing label is empty."""
    f = F.split("value", "\t")
    need = max(c for c in (text_column, id_column, label_column) if c is not None)
    pick = lambda c: F.get(f, F.lit(c)) if c is not None else F.lit("")
    return spark.read.text(path).where(F.size(f) > need).select(pick(id_column).alias("name"), pick(label_column).alias("label"), F.trim(pick(text_column)).alias("text"))


def short_rows(spark: SparkSession, path: str, need: int) -> int:
    """How many lines read_tsv() skips."""
    return spark.read.text(path).where(F.size(F.split("value", "\t")) <= need).count()


def from_texts(spark: SparkSession, texts: Iterable[str | None], names: Iterable[str] | None = None, labels: Iterable[str] | None = None) -> DataFrame:
    texts = list(texts)
    names = list(names) if names is not None else [f"doc_{i}" for i in range(len(texts))]
    labels = list(labels) if labels is not None else [""] * len(texts)
    return spark.createDataFrame(list(zip(range(len(texts)), names, labels, [t or "" for t in texts], strict=True)), "doc_id long, name string, label string, text string")


def read_corpus(spark: SparkSession, path: str, kind: str = "lines", prune: dict | None = None, tokenizer: Callable | None = None, **how) -> DataFrame:
    """Documents of a file or folder as tokens in one call: read by lines or as tsv, tokenised, stopped, pruned.

    how: lowercase, stopwords and min_length of the tokeniser, or columns of read_tsv(); prune: bounds of
    vocabulary.keep_words(). Documents that lose all tokens go.
    """
    columns = {c: how.pop(c) for c in ("text_column", "id_column", "label_column", "id_field") if c in how}
    if kind == "tsv":
        d = read_tsv(spark, path, **columns).withColumn("doc_id", F.monotonically_increasing_id())
    else:
        d = read_lines(spark, path, **columns)
    d = vocabulary.corpus(d, tokenizer=tokenizer, **how)
    return vocabulary.keep_words(d, **prune)[0] if prune else d


def from_tokens(spark: SparkSession, documents: Iterable[list[str]], stopwords: Iterable[str] = (), words: Iterable[str] | None = None, prune: dict | None = None, **columns) -> DataFrame:
    """(doc_id, tokens, and a column for each named list), less stopwords, words outside a given vocabulary and pruned ones.

    Documents that lose all their tokens stay, empty, unless prune is given.
    """
    stop, only = set(stopwords), set(words) if words is not None else None
    documents = [[w for w in d if w not in stop and (only is None or w in only)] for d in documents]
    rows = [{"doc_id": i, "tokens": list(d)} for i, d in enumerate(documents)]
    df = spark.createDataFrame([(r["doc_id"], r["tokens"]) for r in rows], "doc_id long, tokens array<string>")
    for name, values in columns.items():
        df = df.join(spark.createDataFrame(list(enumerate(values)), ["doc_id", name]), "doc_id")
    return vocabulary.keep_words(df, **prune)[0] if prune else df


def read_embeddings(spark: SparkSession, path: str, id_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
    """(doc_id, embedding): vectors as doubles; rows whose vector is null, or holds null or non-finite components, go."""
    v = spark.read.parquet(path).select(F.col(id_col).alias("doc_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    return v.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
