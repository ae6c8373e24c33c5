"""Co-occurrence counts and topic coherence.

Topics are given as (topic, rank, word). Only their words' places are ever joined, so frequent other words cost nothing;
windows are counted from each word's runs of window starts, without one row for each start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import cosine
from ..functions.lineage import cut

EPS = 1e-12
#: Documents times words and pairs that a task of the bootstrap holds at once.
COUNTED = 1_000_000


def word_pairs(topics: DataFrame) -> DataFrame:
    """(topic, hi, lo, w1, w2): pairs of a topic's words, lo ranked below hi."""
    a = topics.select("topic", F.col("rank").alias("hi"), F.col("word").alias("w1"))
    b = topics.select("topic", F.col("rank").alias("lo"), F.col("word").alias("w2"))
    return a.join(b, "topic").where("hi < lo")


def document_counts(docs: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, occ) and (w1, w2, co) over documents, for the topics' words and their pairs within a topic (w1 < w2)."""
    words = F.broadcast(topics.select("word").distinct())
    here = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("word")).join(words, "word", "left_semi")
    occ = here.groupBy("word").agg(F.count("*").alias("occ"))
    pairs = word_pairs(topics).select(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).distinct()
    per_doc = here.groupBy("doc_id").agg(F.array_sort(F.collect_list("word")).alias("ws"))
    both = per_doc.select(F.explode(F.expr("flatten(transform(ws, (a, i) -> transform(slice(ws, i + 2, size(ws)), b -> struct(a as w1, b as w2))))")).alias("p")).select("p.w1", "p.w2")
    co = both.groupBy("w1", "w2").agg(F.count("*").alias("co")).join(F.broadcast(pairs), ["w1", "w2"], "left_semi")
    return occ, co


def window_counts(docs: DataFrame, topics: DataFrame, window: int) -> tuple[int, DataFrame, DataFrame]:
    """The number of windows, (word, occ) and (w1, w2, co) over sliding windows of so many tokens.

    A document of L tokens has max(1, L - window + 1) windows (none if empty). A word's windows are the union of the
    runs of starts its places give; a pair's are what two such unions share. Both are sums over merged runs.
    """
    n = docs.where("size(tokens) > 0").agg(F.sum(F.greatest(F.size("tokens") - (window - 1), F.lit(1)).cast("long"))).first()[0] or 0
    words = F.broadcast(topics.select("word").distinct())
    places = docs.select("doc_id", F.size("tokens").alias("len"), F.posexplode("tokens").alias("pos", "word")).join(words, "word", "left_semi")
    first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    last = F.least(F.col("pos"), F.greatest(F.col("len") - window, F.lit(0)))
    w = Window.partitionBy("doc_id", "word").orderBy("pos")
    runs = places.select("doc_id", "word", "pos", first.alias("a"), last.alias("b"))
    runs = runs.withColumn("new", (F.col("a") > F.coalesce(F.lag("b").over(w), F.lit(-2)) + 1).cast("int")).withColumn("g", F.sum("new").over(w))
    runs = runs.groupBy("doc_id", "word", "g").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    occ = runs.groupBy("word").agg(F.sum(F.col("b") - F.col("a") + 1).alias("occ"))
    lists = runs.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("r"))
    pairs = F.broadcast(word_pairs(topics).select(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).distinct())
    x = lists.select("doc_id", F.col("word").alias("w1"), F.col("r").alias("r1")).join(pairs, "w1")
    both = x.join(lists.select("doc_id", F.col("word").alias("w2"), F.col("r").alias("r2")), ["doc_id", "w2"])
    # what two unions share is their sizes less that of their union, which one pass over the runs of both gives
    length = lambda r: f"aggregate({r}, 0L, (s, p) -> s + cast(p.b - p.a + 1 as bigint))"
    union = """aggregate(sort_array(concat(r1, r2)), named_struct('reach', -1L, 't', 0L), (s, p) -> named_struct('reach', greatest(s.reach, cast(p.b as bigint)),
        't', s.t + greatest(0L, cast(p.b as bigint) - greatest(cast(p.a as bigint) - 1L, s.reach))), s -> s.t)"""
    shared = F.expr(f"{length('r1')} + {length('r2')} - {union}")
    return n, occ, both.select("w1", "w2", shared.alias("c")).where("c > 0").groupBy("w1", "w2").agg(F.sum("c").alias("co"))


def _scored(topics: DataFrame, occ: DataFrame, co: DataFrame) -> DataFrame:
    """Pairs (topic, hi, lo, w1, w2, o1, o2, co) with 0 for what never occurs."""
    p = word_pairs(topics).withColumns({"x": F.least("w1", "w2"), "y": F.greatest("w1", "w2")})
    p = p.join(co.select(F.col("w1").alias("x"), F.col("w2").alias("y"), "co"), ["x", "y"], "left")
    p = p.join(occ.select(F.col("word").alias("w1"), F.col("occ").alias("o1")), "w1", "left").join(occ.select(F.col("word").alias("w2"), F.col("occ").alias("o2")), "w2", "left")
    return p.na.fill(0, ["co", "o1", "o2"]).drop("x", "y")


def npmi(p_ab: Column, p_a: Column, p_b: Column) -> Column:
    p = F.when(p_ab <= 0, EPS).otherwise(p_ab)
    return F.when(p >= 1, 1.0).otherwise(F.log(p / (F.greatest(p_a, F.lit(EPS)) * F.greatest(p_b, F.lit(EPS)))) / -F.log(p))


def coherence(docs: DataFrame, topics: DataFrame, measure: str = "c_v", window: int | None = None) -> DataFrame:
    """(topic, score). u_mass sums over documents; c_uci (window 10), c_npmi (10) and c_v (110) average over windows.

    Words that the documents lack don't count for u_mass; a topic with fewer than two others is NaN. npmi over documents: measure 'npmi_doc'.
    """
    if measure in ("u_mass", "npmi_doc"):
        occ, co = document_counts(docs, topics)
        s = _scored(topics, occ, co)
        if measure == "u_mass":
            s = s.where("o1 > 0 and o2 > 0").groupBy("topic").agg(F.sum(F.log((F.col("co") + 1) / F.col("o1"))).alias("score"))
            return topics.select("topic").distinct().join(s, "topic", "left").select("topic", F.coalesce("score", F.lit(float("nan"))).alias("score"))
        n = docs.where("size(tokens) > 0").count()
        return s.groupBy("topic").agg(F.avg(npmi(F.col("co") / n, F.col("o1") / n, F.col("o2") / n)).alias("score"))
    n, occ, co = window_counts(docs, topics, window or (110 if measure == "c_v" else 10))
    s = _scored(topics, occ, co).withColumns({"p": F.col("co") / n, "p1": F.col("o1") / n, "p2": F.col("o2") / n})
    if measure == "c_uci":
        pmi = F.log((F.col("p") + EPS) / (F.greatest("p1", F.lit(EPS)) * F.greatest("p2", F.lit(EPS))))
        return s.groupBy("topic").agg(F.avg(pmi).alias("score"))
    s = s.withColumn("m", npmi(F.col("p"), F.col("p1"), F.col("p2")))
    if measure == "c_npmi":
        return s.groupBy("topic").agg(F.avg("m").alias("score"))
    # c_v: rows of the npmi matrix (diagonal 1) against the sum of all rows
    full = s.select("topic", F.explode(F.array(F.struct(F.col("w1").alias("i"), F.col("w2").alias("j"), "m"), F.struct(F.col("w2").alias("i"), F.col("w1").alias("j"), "m"))).alias("e")).select("topic", "e.*")
    full = full.unionByName(topics.select("topic", F.col("word").alias("i"), F.col("word").alias("j"), F.lit(1.0).alias("m")))
    col = full.groupBy("topic", F.col("j")).agg(F.sum("m").alias("total"))
    size = col.groupBy("topic").agg(F.sqrt(F.sum(F.col("total") * F.col("total"))).alias("size"))
    rows = full.join(col, ["topic", "j"]).groupBy("topic", "i").agg(F.sum(F.col("m") * F.col("total")).alias("d"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("r"))
    rows = rows.join(size, "topic").withColumn("cos", F.when((F.col("r") > 0) & (F.col("size") > 0), F.col("d") / (F.col("r") * F.col("size"))).otherwise(0.0))
    return rows.groupBy("topic").agg(F.avg("cos").alias("score"))


def semantic_coherence(docs: DataFrame, topics: DataFrame, smooth: float = 0.01) -> DataFrame:
    """(topic, score): sums of ln(smooth + co) - ln(smooth + occ) of the pair's word that comes first over all topics' lists."""
    occ, co = document_counts(docs, topics)
    first = topics.groupBy("word").agg(F.min(F.struct("topic", "rank")).alias("first"))
    s = _scored(topics, occ, co).join(first.select(F.col("word").alias("w1"), F.col("first").alias("f1")), "w1").join(first.select(F.col("word").alias("w2"), F.col("first").alias("f2")), "w2")
    base = F.when(F.col("f1") < F.col("f2"), F.col("o1")).otherwise(F.col("o2"))
    return s.groupBy("topic").agg(F.sum(F.log(smooth + F.col("co")) - F.log(smooth + base)).alias("score"))


def cooccurring_pairs(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(w1, w2, co): documents that hold both of two of the given words."""
    return document_counts(docs, words.select(F.lit(0).alias("topic"), F.col("word").alias("rank"), "word"))[1]


def coherence_over(docs: DataFrame, topics: DataFrame, by: str, measure: str = "u_mass") -> DataFrame:
    """(topic, score): the mean over slices (or groups) of the coherence in each slice's documents. More than 1000 slices raise an error."""
    found = docs.select(by).where(F.col(by).isNotNull()).distinct().orderBy(by).limit(1001).collect()
    if len(found) > 1000:
        raise ValueError(f"{by} has more than 1000 groups")
    parts = [coherence(docs.where(F.col(by) == F.lit(r[0])), topics, measure) for r in found]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("topic").agg(F.avg("score").alias("score"))


def coherence_bootstrap(docs: DataFrame, topics: DataFrame, replicates: int = 100, seed: int = 0) -> DataFrame:
    """(topic, mean, sd, low, high) of u_mass with documents drawn anew: each replicate weighs a document by a Poisson draw of its hash."""
    topics = cut(topics.select("topic", "rank", "word"))
    spark, tied = topics.sparkSession, word_pairs(topics).select(F.least("w1", "w2").alias("x"), F.greatest("w1", "w2").alias("y")).distinct()
    names = sorted(r["word"] for r in topics.select("word").distinct().collect())  # n words a topic
    at = {w: i for i, w in enumerate(names)}
    ties = sorted((at[r["x"]], at[r["y"]]) for r in tied.collect())  # n square pairs a topic
    k, x, y = len(names), np.array([a for a, _ in ties], int), np.array([b for _, b in ties], int)
    ids = F.broadcast(spark.createDataFrame(list(at.items()), "word string, i int"))
    here = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("word")).join(ids, "word")
    draws = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda rep: F.xxhash64(F.lit(seed), rep, "doc_id"))
    per_doc = here.groupBy("doc_id").agg(F.collect_set("i").alias("ws")).select("ws", draws.alias("draws"))
    marks, p, total = [], 0.36787944117144233, 0.0
    for j in range(1, 9):
        total += p
        p /= j
        marks.append(total)

    def run(batches):
        """Weighted counts of words and pairs, of all replicates at once."""
        counts, block = np.zeros((replicates, k + len(x))), max(1, COUNTED // (k + len(x)))
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                size = pc.list_value_length(part.column(0)).to_numpy(zero_copy_only=False)
                has = np.zeros((part.num_rows, k))
                has[np.repeat(np.arange(part.num_rows), size), part.column(0).flatten().to_numpy()] = 1
                u = (part.column(1).flatten().to_numpy().reshape(part.num_rows, replicates) & (1 << 30) - 1) / float(1 << 30)
                counts += np.searchsorted(marks, u, side="right").astype(float).T @ np.hstack((has, has[:, x] * has[:, y]))
        rep, item = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((rep + 1).astype(np.int32)), pa.array(item.astype(np.int32)), pa.array(counts[rep, item].astype(np.int64))], ["rep", "item", "n"])

    counts = cut(per_doc.mapInArrow(run, "rep int, item int, n long").groupBy("rep", "item").agg(F.sum("n").alias("n")))
    occ = counts.join(ids.withColumnRenamed("i", "item"), "item").select("rep", "word", F.col("n").alias("occ"))
    both = spark.createDataFrame([(k + j, names[a], names[b]) for j, (a, b) in enumerate(ties)], "item int, x string, y string")
    co = counts.join(F.broadcast(both), "item").select("rep", "x", "y", F.col("n").alias("co"))
    pairs = word_pairs(topics).withColumns({"x": F.least("w1", "w2"), "y": F.greatest("w1", "w2")})
    s = pairs.join(occ.select("rep", F.col("word").alias("w1"), F.col("occ").alias("o1")), "w1").join(co, ["rep", "x", "y"], "left").join(
        occ.select("rep", F.col("word").alias("w2"), F.lit(1).alias("there")), ["rep", "w2"], "left_semi")
    each = s.groupBy("topic", "rep").agg(F.sum(F.log((F.coalesce("co", F.lit(0)) + 1) / F.col("o1"))).alias("score"))
    return each.groupBy("topic").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.expr("percentile(score, 0.025)").alias("low"), F.expr("percentile(score, 0.975)").alias("high"))


def embedding_coherence(topics: DataFrame, vectors: DataFrame) -> DataFrame:
    """(topic, score): the mean cosine of pairs of a topic's words that have vectors (word, embedding)."""
    t = topics.join(vectors.select("word", "embedding"), "word")
    a = t.select("topic", F.col("rank").alias("hi"), F.col("embedding").alias("x"))
    b = t.select("topic", F.col("rank").alias("lo"), F.col("embedding").alias("y"))
    return a.join(b, "topic").where("hi < lo").groupBy("topic").agg(F.avg(cosine(F.col("x"), F.col("y"))).alias("score"))
