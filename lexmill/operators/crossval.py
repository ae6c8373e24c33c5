"""Folds: hashed k-fold, grouped and temporal splits, and scores over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def kfold(docs: DataFrame, k: int = 5, seed: int = 0, by: str | None = None) -> DataFrame:
    """(doc_id, fold): folds by a hash of the id, or of a group's value, which keeps groups whole. No shuffle, any size."""
    key = F.col(by) if by else F.col("doc_id")
    return docs.select("doc_id", F.pmod(F.xxhash64(F.lit(seed), key.cast("string")), F.lit(k)).cast("int").alias("fold"))


def _ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with nth, their number from 0 in the given order, and n, how many there are.

    Ranges of the order are numbered by themselves; the rows of the ranges before (a number a range) come on top, so no task
    orders them all.
    """
    ranges = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = cut(rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("own"))
    w = Window.orderBy("part")  # one row a range
    starts = sizes.select("part", (F.sum("own").over(w) - F.col("own")).alias("start"), F.sum("own").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("start")
    return parts.join(F.broadcast(starts), "part").withColumn("nth", nth).drop("part", "start")


def balanced_groups(docs: DataFrame, by: str, k: int = 5) -> DataFrame:
    """(doc_id, fold): groups dealt to folds by size, in a boustrophedon order, so fold sizes are close."""
    g = _ranked(docs.groupBy(by).agg(F.count("*").alias("size")), F.desc("size"), F.col(by))
    i = F.col("nth")
    back = F.floor(i / k) % 2 == 1
    folds = g.select(by, F.when(back, k - 1 - i % k).otherwise(i % k).cast("int").alias("fold"))
    return docs.join(folds, by).select("doc_id", "fold")


def temporal(docs: DataFrame, time: str, k: int = 5, rolling: bool = False) -> DataFrame:
    """(fold, doc_id, role): blocks of distinct times in order; fold f tests block f and trains on those before (or on the one before)."""
    times = _ranked(docs.select(F.col(time).alias("t")).where("t is not null").distinct(), F.col("t"))
    # as ntile has them: the first n % (k + 1) blocks hold one more
    size, more, i = F.floor(F.col("n") / (k + 1)), F.col("n") % (k + 1), F.col("nth")
    block = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    blocks = times.select("t", block.cast("int").alias("block"))
    d = docs.join(blocks, docs[time] == blocks["t"]).select("doc_id", "block")
    folds = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold")
    r = d.select("doc_id", "block", folds)
    train = (F.col("block") == F.col("fold")) if rolling else (F.col("block") <= F.col("fold"))
    role = F.when(F.col("block") == F.col("fold") + 1, "test").when(train, "train")
    return r.select("fold", "doc_id", role.alias("role")).where("role is not null")


def cross_validate(docs: DataFrame, folds: DataFrame, fit: Callable, score: Callable, k: int) -> list[float]:
    """score(fit(train), test) for each fold."""
    d = docs.join(folds, "doc_id")
    return [score(fit(d.where(F.col("fold") != f).drop("fold")), d.where(F.col("fold") == f).drop("fold")) for f in range(k)]



def stratified(docs: DataFrame, by: str, k: int = 5, seed: int = 0) -> DataFrame:
    """(doc_id, fold): each value of by is dealt evenly to the folds, in a hashed order. Null is a value of its own.

    Places within a value are counted over its hashed parts, so that no task orders a whole value.
    """
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    d = docs.select("doc_id", F.col(by).cast("string").alias("v"), h.alias("h"), F.pmod(h, F.lit(1024)).alias("part"))
    sizes = d.groupBy("v", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("v").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("v").alias("sv"), F.col("part").alias("sp"), before.alias("start"))
    i = F.row_number().over(Window.partitionBy("v", "part").orderBy("h", "doc_id")) - 1
    return d.withColumn("i", i).join(starts, F.col("v").eqNullSafe(F.col("sv")) & (F.col("part") == F.col("sp"))).select("doc_id", F.pmod(F.col("start") + F.col("i"), F.lit(k)).cast("int").alias("fold"))
