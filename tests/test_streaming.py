import numpy as np
from pyspark.sql import functions as F

from lexmill.models import Corpus, OnlineLDA, OnlineSTM
from lexmill.operators import vocabulary
from lexmill.streaming import online


def test_online_topics_exactly_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, "apple banana cherry" if i % 2 else "river stone water") for i in range(20)], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    words = ["apple", "banana", "cherry", "river", "stone", "water"]
    sink = online.OnlineTopics(OnlineLDA(2, total_docs=20, tau=1.0), words, str(tmp_path / "state"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink.start(stream, str(tmp_path / "ck")).awaitTermination()
    steps = sink.model.t
    assert steps == 2
    sink(docs, 0)  # a replayed batch
    assert sink.model.t == steps
    other = online.OnlineTopics(OnlineLDA(2, total_docs=20), words, str(tmp_path / "state"))
    other.restore(spark)
    assert other.last == sink.last and (other.model.lam == sink.model.lam).all()


def test_event_windows_stream_equals_table(spark, tmp_path):
    e = spark.createDataFrame([(i, i % 3, "a" if i % 2 else "b", float(i)) for i in range(60)], "event_id long, user_id long, event_type string, value double")
    e = e.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 300))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = online.event_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r["start"], r["event_type"], r["n"], r["total"]) for r in df.collect())
    assert key(spark.table("windows")) == key(online.event_windows(e))
    assert online.event_sessions(e, "10 minutes").count() == 60


def test_structural_model_from_a_stream(spark, tmp_path):
    """The stream's steps equal those of a loop over the same batches, and a restarted sink goes on from its state."""
    rng = np.random.default_rng(0)
    kinds = [["apple", "banana", "cherry"], ["river", "stone", "water"]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 12)), [float(i % 2)]) for i in range(60)]
    schema = "doc_id long, text string, features array<double>"
    words = sorted(sum(kinds, []))
    parts = [spark.createDataFrame(rows[k::3], schema) for k in range(3)]
    for k, p in enumerate(parts):
        p.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    loop = OnlineSTM(2, 1, total_docs=60, seed=1)
    seen = []
    sink = online.OnlineTopics(OnlineSTM(2, 1, total_docs=60, seed=1), words, str(tmp_path / "state"))
    take = sink.__call__

    def spy(batch, n):
        seen.append((n, sorted(r["doc_id"] for r in batch.select("doc_id").collect())))
        take(batch, n)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(spy).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sink.model.t == 3
    for _, ids in sorted(seen):
        own = spark.createDataFrame([r for r in rows if r[0] in ids], schema)
        loop.partial_fit(Corpus(vocabulary.corpus(own), words=words, carry=("features",)))
    assert np.allclose(loop.beta, sink.model.beta, atol=1e-6) and np.allclose(loop.coef, sink.model.coef, atol=1e-5)
    sink(parts[0], 2)  # a replayed batch
    assert sink.model.t == 3
    other = online.OnlineTopics(OnlineSTM(2, 1, total_docs=60), words, str(tmp_path / "state"))
    other.restore(spark)
    assert other.last == 2 and (other.model.beta == sink.model.beta).all() and (other.model.sums[0] == sink.model.sums[0]).all()
    assert {frozenset(sorted(ws[:3])) for ws in [[words[i] for i in np.argsort(-b)[:3]] for b in sink.model.shared]} == {frozenset(k) for k in kinds}
