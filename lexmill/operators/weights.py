"""Word weights: tf-idf, class-based tf-idf, group contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .vocabulary import bag

#: Words whose document counts are sent to all tasks: the most frequent.
SENT = 250_000


def idf(vocab: DataFrame, n_docs: int) -> DataFrame:
    return vocab.select("word", F.log(F.lit(float(n_docs)) / F.col("df")).alias("idf"))


def tfidf(docs: DataFrame, n_docs: int | None = None, normalise: bool = True) -> DataFrame:
    """(doc_id, word, weight): tf * (ln((1 + D) / (1 + df)) + 1), each document of length 1.

    Documents are dealt once, as token lists. The counts of frequent words are sent to them; only rows of rare words are
    shuffled to find theirs.
    """
    dealt = docs.select("doc_id", "tokens").repartition("doc_id").persist()  # read three times
    b = bag(dealt)
    n_docs = dealt.count() if n_docs is None else n_docs
    # documents without an id can't be met again by it, so their words are sent too
    df = cut(b.groupBy("word").agg(F.count("*").alias("df"), F.max(F.col("doc_id").isNull()).alias("unnamed")))
    if df.count() <= SENT:
        known = b.join(F.broadcast(df.select("word", "df")), "word")
    else:
        least, left = 1, SENT
        for r in df.groupBy("df").agg(F.count("*").alias("words")).orderBy(F.desc("df")).toLocalIterator():  # a row a different count
            left -= r["words"]
            if left < 0:
                least = r["df"] + 1
                break
        sent = F.broadcast(df.where((F.col("df") >= least) | F.col("unnamed")).select("word", "df"))
        rare = dealt.select("doc_id", F.explode(F.array_distinct("tokens")).alias("word")).join(sent, "word", "left_anti").join(df.select("word", "df"), "word")
        own = rare.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "df"))).alias("rare"))
        known = b.join(sent, "word", "left").join(own, "doc_id", "left").withColumn("df", F.coalesce("df", F.col("rare")[F.col("word")]))
    out = known.select("doc_id", "word", (F.col("n") * (F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1)).alias("weight"))
    if not normalise:
        return out
    size = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc_id")))
    return out.select("doc_id", "word", (F.col("weight") / size).alias("weight"))


def class_counts(docs: DataFrame, by: str) -> DataFrame:
    """(class, word, n). Each document's words are summed in its task before they are shuffled; null and -1 are no class."""
    return docs.where(F.col(by).isNotNull() & (F.col(by).cast("string") != "-1")).select(F.col(by).alias("class"), F.explode("tokens").alias("word")).groupBy("class", "word").agg(F.count("*").alias("n"))


def ctfidf(counts: DataFrame, variant: str = "default", reduce_frequent: bool = False, n_classes: int | None = None) -> DataFrame:
    """(class, word, weight): tf * ln(1 + A / f), A the mean tokens of a class and f the word's total.

    bm25: ln(1 + (A - f + .5) / (f + .5)), null where that is below 0; reduce_frequent takes the root of tf.
    """
    f = counts.groupBy("word").agg(F.sum("n").alias("f"))
    total = counts.agg((F.sum("n") / (F.lit(n_classes) if n_classes else F.countDistinct("class"))).alias("a"))
    j = counts.join(f, "word").join(F.broadcast(total), F.lit(True))  # one row
    tf = F.sqrt(F.col("n").cast("double")) if reduce_frequent else F.col("n").cast("double")
    inside = 1 + (F.col("a") - F.col("f") + 0.5) / (F.col("f") + 0.5) if variant == "bm25" else 1 + F.col("a") / F.col("f")
    return j.select("class", "word", (tf * F.log(inside)).alias("weight"))


def cluster_tfidf(docs: DataFrame, by: str) -> DataFrame:
    """(class, word, weight): unit tf-idf averaged over a class, times ln((1 + K) / (1 + cf)) + 1, each class summing to 1."""
    t = tfidf(docs).join(docs.select("doc_id", F.col(by).alias("class")), "doc_id")
    size = docs.groupBy(F.col(by).alias("class")).agg(F.count("*").alias("size"))
    mean = cut(t.groupBy("class", "word").agg(F.sum("weight").alias("s")).join(F.broadcast(size), "class").withColumn("m", F.col("s") / F.col("size")))
    k = size.agg(F.count("*").alias("k"))
    cf = mean.groupBy("word").agg(F.count("*").alias("cf"))
    w = mean.join(cf, "word").join(F.broadcast(k), F.lit(True)).withColumn("w", F.col("m") * (F.log((1.0 + F.col("k")) / (1.0 + F.col("cf"))) + 1))
    total = w.groupBy("class").agg(F.sum("w").alias("total"))
    return w.join(F.broadcast(total), "class").select("class", "word", (F.col("w") / F.col("total")).alias("weight"))


def fighting_words(docs: DataFrame, by: str, a, b, prior: float = 0.01, informative: bool = False, min_count: int = 1) -> DataFrame:
    """(word, n_a, n_b, z): weighted log-odds of two groups. Totals run over the full vocabulary; min_count filters the output only."""
    t = docs.where(F.col(by).isin(a, b)).select(F.col(by).alias("g"), F.explode("tokens").alias("word"))
    n = t.groupBy("word").agg(F.count(F.when(F.col("g") == a, 1)).alias("n_a"), F.count(F.when(F.col("g") == b, 1)).alias("n_b"))
    n = n.withColumn("p", F.lit(float(prior)) * (F.col("n_a") + F.col("n_b")) if informative else F.lit(float(prior)))
    total = n.agg(F.sum("n_a").alias("t_a"), F.sum("n_b").alias("t_b"), F.sum("p").alias("t_p"))
    j = n.join(F.broadcast(total), F.lit(True))  # one row
    odds = lambda n, t: F.log((F.col(n) + F.col("p")) / (F.col(t) + F.col("t_p") - F.col(n) - F.col("p")))
    z = (odds("n_a", "t_a") - odds("n_b", "t_b")) / F.sqrt(1 / (F.col("n_a") + F.col("p")) + 1 / (F.col("n_b") + F.col("p")))
    return j.select("word", "n_a", "n_b", z.alias("z")).where((F.col("n_a") + F.col("n_b")) >= min_count)


def keyword_shares(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(topic, word, cf, df, share): keyword counts, and their share of all tokens."""
    hit = F.broadcast(keywords.select("word").distinct())
    t = bag(docs)
    total = docs.agg(F.sum(F.size("tokens").cast("long")).alias("total"))
    c = t.join(hit, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))
    j = keywords.join(c, "word", "left").na.fill(0, ["cf", "df"]).join(F.broadcast(total), F.lit(True))
    return j.select("topic", "word", "cf", "df", (F.col("cf") / F.col("total")).alias("share"))
