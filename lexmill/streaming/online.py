"""Streams: incremental topic models, running vocabularies and event windows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.base import Corpus
from ..models.logistic import OnlineSTM
from ..models.variational import OnlineLDA
from ..operators.vocabulary import corpus as tokenised


class OnlineTopics:
    """foreachBatch sink that takes one stochastic step a micro-batch. Words outside the vocabulary are dropped.

    The model (OnlineLDA or OnlineSTM), its step and the last batch id are written together after each step, and a batch id
    already seen is skipped, so a replayed micro-batch counts once. Columns that the model carries come with the text.
    """

    def __init__(self, model: OnlineLDA | OnlineSTM, words: list[str], state: str, text_col: str = "text"):
        self.model, self.words, self.state, self.text_col, self.last = model, words, state, text_col, -1

    def restore(self, spark: SparkSession) -> None:
        try:
            rows = spark.read.parquet(self.state).orderBy(F.desc("batch")).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return
            raise
        if rows:
            self.last, self.model.t = rows[0]["batch"], rows[0]["t"]
            self.model.take(bytes(rows[0]["lam"]))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        self.model.partial_fit(Corpus(tokenised(batch.select("doc_id", *self.model.carry, self.text_col), self.text_col), words=self.words, carry=self.model.carry))
        self.last = batch_id
        if self.model.t:
            batch.sparkSession.createDataFrame([(batch_id, self.model.t, bytearray(self.model.state()))], "batch long, t long, lam binary").write.mode("append").parquet(self.state)

    def start(self, stream: DataFrame, checkpoint: str):
        self.restore(stream.sparkSession)
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, event_type, n, total): windows of event time with a watermark; for streams and tables alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): sessions parted by a gap."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_vocabulary(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, cf) over a stream of documents, for the complete output mode."""
    t = tokenised(stream.select("doc_id", text_col), text_col)
    return t.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("cf"))


def progress_json(query) -> str:
    return json.dumps(query.lastProgress, default=str)
