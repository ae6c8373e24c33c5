"""Topics from clusters of document embeddings, found by KMeans."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import cosine
from ..operators import density, embedding, selection, topics, vocabulary, weights


class BERTopic:
    """Clusters named by class-based tf-idf. Given labels are taken as they are; -1 is noise.

    With min_cluster, clusters are those of density_clusters() instead of KMeans; reduce_to merges the smallest topics
    into their nearest until so many are left.
    """

    def __init__(self, k: int = 10, top_n: int = 10, seed: int = 0, min_cluster: int | None = None, reduce_to: int | None = None):
        self.k, self.top_n, self.seed, self.min_cluster, self.reduce_to = k, top_n, seed, min_cluster, reduce_to

    def fit(self, docs: DataFrame, vectors: DataFrame, labels: DataFrame | None = None):
        """docs (doc_id, tokens), vectors (doc_id, embedding), labels (doc_id, topic). Sets labels, topics and centroids."""
        if labels is None and self.min_cluster:
            labels = density.density_clusters(vectors, self.min_cluster)
        elif labels is None:
            v = vectors.select("doc_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
            labels = KMeans(k=self.k, seed=self.seed).fit(v).transform(v).select("doc_id", F.col("prediction").alias("topic"))
        if self.reduce_to:
            c = embedding.centroids(vectors.join(labels, "doc_id").where("topic >= 0"), "topic")
            labels = topics.merge_labels(labels, selection.reduce_topics(c.select("topic", "centroid"), c.select("topic", "n"), self.reduce_to))
        self.labels = labels
        counts = weights.class_counts(docs.join(labels, "doc_id"), "topic")
        self.topics = vocabulary.top_words(weights.ctfidf(counts), "class", "weight", self.top_n).withColumnRenamed("class", "topic")
        self.centroids = embedding.centroids(vectors.join(labels, "doc_id").where("topic <> -1"), "topic")
        return self

    def save(self, path: str) -> None:
        for name in ("labels", "topics", "centroids"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        m = cls()
        m.labels, m.topics, m.centroids = (spark.read.parquet(f"{path}/{name}") for name in ("labels", "topics", "centroids"))
        return m

    def info(self) -> DataFrame:
        """(topic, n, words); noise comes last."""
        words = self.topics.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("words"))
        return self.labels.groupBy("topic").agg(F.count("*").alias("n")).join(words, "topic", "left").orderBy(F.col("topic") == -1, "topic")


class Top2Vec(BERTopic):
    """As BERTopic, with topics' words read off by nearness to the mean vector of their cluster."""

    def nearest_words(self, word_vectors: DataFrame) -> DataFrame:
        s = word_vectors.join(F.broadcast(self.centroids), F.lit(True)).select("topic", "word", cosine(F.col("embedding"), F.col("centroid")).alias("cosine"))
        return vocabulary.top_words(s, "topic", "cosine", self.top_n)
