"""Reply threads: structure, copied text, speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def structure(posts: DataFrame) -> DataFrame:
    """(id, root, depth, has_child) of posts (id, parent). Pointers double each round, so deep threads take few.

    A parent that isn't a post makes a root. Posts that never reach one lie on a cycle: their root and depth are null.
    """
    known = posts.select(F.col("id").alias("known"))
    s = cut(posts.join(known, F.col("parent") == F.col("known"), "left").select(
        "id", F.col("known").alias("up"), F.coalesce("known", "id").alias("root"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    for _ in range(max(1, s.count()).bit_length()):
        if not s.where("up is not null").limit(1).count():
            break
        a = s.select(F.col("id").alias("aid"), F.col("up").alias("aup"), F.col("root").alias("aroot"), F.col("depth").alias("adepth"))
        s = cut(s.join(a, F.col("up") == F.col("aid"), "left").select(
            "id", F.col("aup").alias("up"), F.coalesce("aroot", "root").alias("root"), (F.col("depth") + F.coalesce("adepth", F.lit(0))).alias("depth")))
    kids = posts.where("parent is not null").select(F.col("parent").alias("kid_of")).distinct()
    out = s.join(kids, F.col("id") == F.col("kid_of"), "left")
    lost = F.col("up").isNotNull()
    return out.select("id", F.when(~lost, F.col("root")).alias("root"), F.when(~lost, F.col("depth")).alias("depth"), F.col("kid_of").isNotNull().alias("has_child"))


def copied_positions(docs: DataFrame, parents: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, pos): token positions that lie in a run of n words which the parent (doc_id, parent) has too."""
    grams = docs.where(F.size("tokens") >= n).select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tokens") - (n - 1)), lambda i: F.array_join(F.slice("tokens", i, n), " "))).alias("pos", "gram"))
    own = grams.join(parents.select("doc_id", "parent").where("parent is not null"), "doc_id")
    theirs = grams.select(F.col("doc_id").alias("parent"), "gram").distinct()
    hit = own.join(theirs, ["parent", "gram"], "left_semi")
    return hit.select("doc_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + (n - 1))).alias("pos")).distinct()


def strip_copied(docs: DataFrame, parents: DataFrame, n: int = 5) -> DataFrame:
    """docs less the tokens copied from their parents."""
    gone = copied_positions(docs, parents, n).groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("tokens") - 1), F.col("gone"))
    out = docs.join(gone, "doc_id", "left")
    return out.withColumn("tokens", F.when(F.col("gone").isNull() | (F.size("tokens") == 0), F.col("tokens")).otherwise(F.transform(keep, lambda i: F.get("tokens", i)))).drop("gone")


def speakers(turns: DataFrame) -> DataFrame:
    """(role, turns, conversations, words): what each speaker says."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    return turns.groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.sum(words.cast("long")).alias("words"))


def shuffle_parents(posts: DataFrame, seed: int = 0) -> DataFrame:
    """(id, parent): parents permuted among posts of the same root and depth."""
    s = structure(posts).join(posts, "id").where("depth > 0")
    a = s.withColumn("k", F.row_number().over(Window.partitionBy("root", "depth").orderBy("id")))
    b = s.withColumn("k", F.row_number().over(Window.partitionBy("root", "depth").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))).select("root", "depth", "k", F.col("parent").alias("other"))
    moved = a.join(b, ["root", "depth", "k"]).select("id", F.col("other").alias("parent"))
    return moved.unionByName(posts.join(moved.select("id"), "id", "left_anti").select("id", "parent"))
