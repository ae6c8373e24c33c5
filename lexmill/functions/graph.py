"""Connected components of edges, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (id, component_id), the smallest id reachable.

    Alternates large-star and small-star rounds (Kiveris et al., 2014). Minima are taken by groupBy, so a hub is
    pre-aggregated in each task, and handed back by a join that AQE can split. Null ends and self-loops are ignored;
    ids without any other edge aren't listed.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    seen = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not now["n"] or seen == tuple(now):
            break
        seen = tuple(now)
        # large-star: every larger neighbour of v goes to the least of v and its neighbours
        least = e.select(F.col("v").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = least.groupBy("x").agg(F.min("y").alias("m"))
        e = e.join(least, e.v == least.x).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: u and its smaller neighbours go to the least of them
        low = e.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        both = e.join(low, e.u == low.x).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
        e = cut(both.select("s.u", "s.v").where("u <> v").distinct())
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).unionAll(
        e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
