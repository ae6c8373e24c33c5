"""Jobs for spark-submit: preprocess, train, analyze, show. Each reads and writes tables in folders."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models
from .operators import vocabulary as V
from .sources import readers, writers


def _read(spark: SparkSession, a) -> DataFrame:
    if a.format == "tsv":
        return readers.read_tsv(spark, a.input).withColumn("doc_id", F.monotonically_increasing_id())
    return spark.read.parquet(a.input) if a.format == "parquet" else readers.read_lines(spark, a.input, a.id_field)


def preprocess(spark: SparkSession, a) -> None:
    stop = {r["value"].strip() for r in spark.read.text(a.stoplist).collect()} if a.stoplist else ()
    docs = V.corpus(_read(spark, a), a.text, stopwords=stop)
    keep = V.prune(V.vocabulary(docs), docs.count(), a.min_df, a.max_df)
    writers.save_corpus(V.transform(docs, keep), a.output, {"min_df": a.min_df, "max_df": a.max_df, "stopwords": len(stop)})


def train(spark: SparkSession, a) -> None:
    docs, _ = writers.load_corpus(spark, a.input)
    m = models.LDA(a.topics, iters=a.iters, seed=a.seed).fit(models.Corpus(docs))
    m.save(spark, a.output)
    writers.write_topic_words(m.phi(spark), f"{a.output}/topic_words_tsv")
    writers.write_doc_topics(m.theta, f"{a.output}/doc_topics_tsv", list(range(a.topics)))


def analyze(spark: SparkSession, a) -> None:
    docs, _ = writers.load_corpus(spark, a.input)
    vocab, n = V.vocabulary(docs), docs.count()
    for kind in ("frequent", "short", "numeric", "non_alpha"):
        print(kind)
        V.stopword_candidates(vocab, n, kind, a.show).show(a.show, truncate=False)


def show(spark: SparkSession, a) -> None:
    m = models.TopicModel.load(spark, a.input)
    for k, words in enumerate(m.top_words(a.show)):
        print(k, " ".join(words))
    if m.theta is not None:
        m.theta.where(F.col("p") >= a.least).orderBy("doc_id", F.desc("p")).show(a.show, truncate=False)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=["preprocess", "train", "analyze", "show"])
    p.add_argument("--input", required=True)
    p.add_argument("--output")
    p.add_argument("--format", choices=["text", "tsv", "parquet"], default="text")
    p.add_argument("--text", default="text")
    p.add_argument("--id-field", action="store_true")
    p.add_argument("--stoplist")
    p.add_argument("--min-df", type=int, default=1)
    p.add_argument("--max-df", type=float, default=1.0)
    p.add_argument("--topics", type=int, default=20)
    p.add_argument("--iters", type=int, default=30)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--show", type=int, default=20)
    p.add_argument("--least", type=float, default=0.1)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"lexmill-{a.job}").getOrCreate()
    {"preprocess": preprocess, "train": train, "analyze": analyze, "show": show}[a.job](spark, a)


if __name__ == "__main__":
    main()
