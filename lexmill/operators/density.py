"""Clusters by density (HDBSCAN), exactly: the mutual-reachability graph's minimum spanning tree, condensed from below.

The tree is Boruvka's: in each round every component takes its least edge to another one. Most are among the listed
neighbours of its points; an edge that neither end lists is at least as long as both ends' distance to their last listed
neighbour, so only points for which that is below their component's best listed edge are compared with all others, in
blocks. The largest component waits for the others to reach it.

The tree's edges, from the shortest, merge components; one that reaches the least size is a cluster, two that have it make
their union a new one. Merging takes the edges a bounded chunk at a time: between chunks components, their sizes and
clusters are tables. The driver sees the tree of clusters, not the points or edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import components
from ..functions.lineage import cut
from .embedding import HELD, cosine_top_k

NOISE = -1
#: Clusters that the driver chooses from.
MOST = 1_000_000
#: Points of a block, and edges that are merged at once.
BLOCK, CHUNK = 1024, 1_000_000
#: Distances are rounded to so many places, so that both ends of an edge agree on it.
PLACES = 12
#: Distances below this count as it, or the density of equal vectors would be without bound.
LEAST = 1e-9


def reachability(vectors: DataFrame, neighbours: int, id_col: str = "doc_id", vec: str = "embedding") -> DataFrame:
    """(a, b, d) with a < b: cosine distances of neighbours, raised to both sides' distance to their last neighbour."""
    return _listed(vectors, neighbours, id_col, vec)[0].select("a", "b", F.col("w").alias("d"))


def _listed(vectors: DataFrame, neighbours: int, id_col: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Listed edges (a, b, w) with a < b, and core distances (id, core)."""
    near = cut(cosine_top_k(vectors, vectors, neighbours, id_col, vec).select(F.col("query").alias("a"), F.col("id").alias("b"), F.round(F.greatest(1 - F.col("cosine"), F.lit(0.0)), PLACES).alias("d")))
    core = cut(near.groupBy(F.col("a").alias("id")).agg(F.max("d").alias("core")))
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))
    j = pairs.join(core.select(F.col("id").alias("a"), F.col("core").alias("ca")), "a").join(core.select(F.col("id").alias("b"), F.col("core").alias("cb")), "b")
    return cut(j.select("a", "b", F.greatest("d", "ca", "cb").alias("w"))), core


def _packed(batches):
    """Blocks (dim, n, ids, comps, cores, v) of rows (id, comp, core, v), with unit vectors."""
    held: dict[int, list] = {}

    def emit(dim):
        ids, comps, cores, v = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        for lo in range(0, len(ids), BLOCK):
            cells = [x[lo : lo + BLOCK] for x in (ids, comps, cores, v)]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(cells[0])], pa.int32()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells)], ["dim", "n", "ids", "comps", "cores", "v"])

    for batch in batches:
        lists = batch.column("v")
        size = np.array([len(x) for x in lists])
        ids, comps, cores = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "comp", "core"))
        for dim in np.unique(size).tolist():
            at = np.flatnonzero(size == dim)
            x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            held.setdefault(dim, []).append((ids[at], comps[at], cores[at], x))
            if sum(len(h[0]) for h in held[dim]) >= BLOCK:
                yield from emit(dim)
    for dim in list(held):
        yield from emit(dim)


def _foreign(batches):
    """The least edge of each component of a query block to points of other components, by blocks of a group."""
    place, held = None, []
    for batch in batches:
        for r in range(batch.num_rows):
            g, dim, is_query = (batch.column(c)[r].as_py() for c in range(3))
            ids, comps = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in ("ids", "comps"))
            cores, v = (np.frombuffer(batch.column(c)[r].as_buffer(), float) for c in ("cores", "v"))
            v = v.reshape(-1, dim)
            if (g, dim) != place:
                place, held = (g, dim), []
            if not is_query:
                held.append((ids, comps, cores, v))
                continue
            best, other = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
            for there, their, core, y in held:
                w = np.round(np.maximum(1 - v @ y.T, 0.0), PLACES)
                w = np.maximum(np.maximum(w, core[None, :]), cores[:, None])
                w[comps[:, None] == their[None, :]] = np.inf
                order = np.argsort(there, kind="stable")  # of equal edges that to the least id
                j = order[w[:, order].argmin(axis=1)]
                low = w[np.arange(len(ids)), j]
                new = (low < best) | ((low == best) & (there[j] < other))
                best, other = np.where(new, low, best), np.where(new, there[j], other)
            on = np.isfinite(best)
            lo, hi = np.minimum(ids, other)[on], np.maximum(ids, other)[on]
            order = np.lexsort((hi, lo, best[on], comps[on]))
            comp = comps[on][order]
            first = order[np.flatnonzero(np.r_[True, comp[1:] != comp[:-1]])] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (comps[on][first], best[on][first], lo[first], hi[first])], ["comp", "w", "a", "b"])


def _least() -> Column:
    return F.min(F.struct("w", "a", "b")).alias("e")


def spanning_tree(vectors: DataFrame, neighbours: int = 10, id_col: str = "doc_id", vec: str = "embedding") -> DataFrame:
    """(a, b, w) with a < b: a minimum spanning tree of the vectors' mutual reachability, ties to the smaller (a, b).

    A vector's core distance is that to the last of its neighbours (the vector itself not counted). Null ids and vectors
    that are null, empty or hold null or non-finite components take no part; vectors of different lengths are never
    joined, so there are as many trees as lengths.
    """
    usable = f"`{vec}` is not null and size(`{vec}`) > 0 and not exists(`{vec}`, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    points = cut(vectors.where(usable).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).dropDuplicates(["id"]))
    edges, core = _listed(points, neighbours, "id", "v")
    points = cut(points.join(core, "id", "left").withColumn("core", F.coalesce("core", F.lit(0.0))))
    labels = cut(points.select("id", F.col("id").alias("comp")))
    n = points.count()
    groups = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-n // (HELD * BLOCK)))
    tree = None
    edges = edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    while True:
        sizes = labels.groupBy("comp").agg(F.count("*").alias("n"))
        top = sizes.orderBy(F.desc("n"), "comp").limit(2).collect()
        if len(top) < 2:
            break
        both = F.explode(F.array(F.col("ca"), F.col("cb"))).alias("comp")
        known = edges.select(both, "w", "a", "b").groupBy("comp").agg(_least())
        open_ = points.join(labels, "id").where(F.col("comp") != top[0]["comp"]).join(known, "comp", "left").where(F.col("e").isNull() | (F.col("core") < F.col("e.w")))
        pack = lambda df: df.select("id", "comp", "core", "v").mapInArrow(_packed, "dim int, n int, ids binary, comps binary, cores binary, v binary")
        q = pack(open_).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        blocks = pack(points.join(labels, "id")).withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
        sides = [df.select("g", "dim", F.lit(k).alias("is_query"), "ids", "comps", "cores", "v") for k, df in ((False, blocks), (True, q))]
        met = sides[0].unionByName(sides[1]).repartition("g", "dim").sortWithinPartitions("g", "dim", "is_query")
        found = met.mapInArrow(_foreign, "comp long, w double, a long, b long")
        listed = known.where(F.col("comp") != top[0]["comp"]).select("comp", "e.w", "e.a", "e.b")
        best = cut(listed.unionByName(found).groupBy("comp").agg(_least()).select("comp", "e.*"))
        if best.isEmpty():  # vectors of different lengths
            break
        chosen = cut(best.select("w", "a", "b").distinct())
        tree = chosen if tree is None else tree.unionByName(chosen)
        ends = chosen.join(labels.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b")
        roots = cut(components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))))

        def moved(df, c, roots=roots):
            return df.join(roots.select(F.col("id").alias("old"), "component_id"), F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("component_id", c)).drop("old", "component_id")

        labels = cut(moved(labels, "comp"))
        edges = cut(moved(moved(edges, "ca"), "cb").where("ca <> cb"))
    if tree is None:
        return vectors.sparkSession.createDataFrame([], "a long, b long, w double")
    return tree.select("a", "b", "w")


#: Rows of a merged chunk. `moved`: component a becomes b, and its points join cluster node if it isn't null. `size`: component
#: a has n points and is of cluster node. `sum`: w is added to what cluster a's points stay for. `split`: cluster a
#: is made of clusters b and n, at density w.
MERGED = "kind string, a long, b long, n long, node long, w double"


def _merge(min_cluster: int):
    """Merges a chunk's edges (nth, a, b, w, and of both components size and cluster), in order, in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        up: dict[int, int] = {}
        size: dict[int, int] = {}
        node: dict[int, int | None] = {}
        joined: dict[int, int] = {}  # components whose points joined a cluster here
        sums: dict[int, float] = {}
        out = []

        def find(x):
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for side in ("a", "b"):
            for x, n, c in zip(pdf[side], pdf[f"n{side}"], pdf[f"node{side}"], strict=True):
                size[x], node[x] = int(n), None if pd.isna(c) else int(c)
        parts = {x: [x] for x in size if node[x] is None}  # components without a cluster, by their root
        for nth, a, b, w in zip(pdf["nth"], pdf["a"], pdf["b"], pdf["w"], strict=True):
            a, b = find(a), find(b)
            if a == b:
                continue
            density, n = 1 / max(w, LEAST), size[a] + size[b]
            if node[a] is not None and node[b] is not None:
                made = int(nth)
                out.append(("split", made, node[a], node[b], None, density))
                sums[made] = sums.get(made, 0.0) + n * density
            else:
                made = node[a] if node[a] is not None else node[b]
                fresh = made is None and n >= min_cluster
                if fresh:
                    made = int(nth)
                if made is not None:
                    for x in (a, b):
                        if node[x] is None:
                            sums[made] = sums.get(made, 0.0) + size[x] * density
                            joined.update((p, made) for p in parts.pop(x))
            a, b = min(a, b), max(a, b)
            up[b] = a
            size[a], node[a] = n, made
            if made is None:
                parts[a] += parts.pop(b)
            else:
                parts.pop(a, None)
                parts.pop(b, None)
        starts = set(pdf["a"]) | set(pdf["b"])
        out += [("moved", int(x), int(find(x)), None, joined.get(x), None) for x in starts]
        out += [("size", int(x), None, size[x], node[x], None) for x in {find(y) for y in starts}]
        out += [("sum", c, None, None, None, s) for c, s in sums.items()]
        return pd.DataFrame(out, columns=["kind", "a", "b", "n", "node", "w"]).astype({"a": "Int64", "b": "Int64", "n": "Int64", "node": "Int64"})

    return run


def _chosen(sums: dict[int, float], kids: dict[int, tuple[int, int, float]], sizes: dict[int, int]) -> dict[int, int]:
    """The chosen cluster of each cluster node that lies in one: those whose points stay longer than their parts' do.

    sums: what the points of a cluster stay for; kids: a split cluster's parts and the density there. A cluster that is
    part of none is the whole, and never chosen.
    """
    born = {c: d for left, right, d in kids.values() for c in (left, right)}
    order = sorted(sums)  # a cluster is numbered after its parts
    worth, best = {}, {}
    for c in order:
        own = sums[c] - sizes[c] * born[c] if c in born else -np.inf
        below = sum(worth[x] for x in kids[c][:2]) if c in kids else 0.0
        best[c] = own >= below if c in kids else c in born
        worth[c] = max(own, below) if c in born else below
    found: dict[int, int] = {}
    for c in reversed(order):
        own = found.get(c, c if best[c] else None)
        if own is not None:
            found[c] = own
        for x in kids.get(c, ())[:2]:
            if own is not None:
                found[x] = own
    return found


def density_clusters(vectors: DataFrame, min_cluster: int = 10, neighbours: int = 10, id_col: str = "doc_id", vec: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """(id_col, topic): clusters numbered from 0, the largest first, and -1 for noise. Ids are integers.

    Vectors that are null or hold null or non-finite components are noise; rows that repeat an id are one point; no rows:
    no rows. What never splits is the whole, not a cluster.
    """
    spark = vectors.sparkSession
    ids = vectors.select(F.col(id_col).cast("long").alias("id"))
    tree = cut(spanning_tree(vectors, neighbours, id_col, vec))
    n = tree.count()
    none = ids.select(F.col("id").alias(id_col), F.lit(NOISE).alias("topic"))
    if not n:
        return none
    # edges are numbered by rank within ranges, whose sizes give the ranks before them
    parts = cut(tree.repartitionByRange(max(1, min(1000, n // 100_000)), "w", "a", "b").withColumn("part", F.spark_partition_id()))
    before = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # 1000 rows at most
    w = Window.partitionBy("part").orderBy("w", "a", "b")
    edges = cut(parts.join(F.broadcast(before), "part").select((F.row_number().over(w) + F.col("before")).cast("long").alias("nth"), "a", "b", "w"))
    labels = cut(ids.where("id is not null").distinct().select("id", F.col("id").alias("comp"), F.lit(None).cast("long").alias("node")))
    comps = labels.select("comp", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("node"))
    sums: dict[int, float] = {}
    kids: dict[int, tuple[int, int, float]] = {}
    for lo in range(0, n, chunk):
        own = edges.where((F.col("nth") > lo) & (F.col("nth") <= lo + chunk))
        for side in ("a", "b"):
            own = own.join(labels.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}")), side)
            own = own.join(comps.select(F.col("comp").alias(f"c{side}"), F.col("n").alias(f"n{side}"), F.col("node").alias(f"node{side}")), f"c{side}")
        own = own.select("nth", F.col("ca").alias("a"), F.col("cb").alias("b"), "w", "na", "nb", "nodea", "nodeb")
        merged = cut(own.groupBy().applyInPandas(_merge(min_cluster), MERGED))  # chunk rows at most
        tree_rows = merged.where("kind in ('split', 'sum')")
        for r in tree_rows.limit(2 * MOST + 1).collect():
            if r["kind"] == "sum":
                sums[r["a"]] = sums.get(r["a"], 0.0) + r["w"]
            else:
                kids[r["a"]] = (r["b"], r["n"], r["w"])
        if len(sums) > MOST:
            raise ValueError(f"more than {MOST} clusters: raise min_cluster")
        to = merged.where("kind = 'moved'").select(F.col("a").alias("old"), F.col("b").alias("new"), F.col("node").alias("joined"))
        labels = cut(labels.join(to, F.col("comp") == F.col("old"), "left").select("id", F.coalesce("new", "comp").alias("comp"), F.coalesce("node", "joined").alias("node")))
        fresh = merged.where("kind = 'size'").select(F.col("a").alias("comp"), "n", "node")
        comps = cut(comps.join(to, F.col("comp") == F.col("old"), "left_anti").unionByName(fresh))
    # points of a cluster: those that joined it and those of its parts
    sizes = {r["node"]: r["count"] for r in labels.where("node is not null").groupBy("node").count().collect()}  # as many as clusters
    for c in sorted(sums):
        sizes[c] = sizes.get(c, 0) + sum(sizes[x] for x in kids.get(c, ())[:2])
    found = _chosen(sums, kids, sizes)
    rank = {c: i for i, c in enumerate(sorted(set(found.values()), key=lambda c: (-sizes[c], c)))}
    if not rank:
        return none
    named = spark.createDataFrame([(c, rank[x]) for c, x in found.items()], "node long, topic int")
    labelled = labels.join(F.broadcast(named) if len(found) <= 500_000 else named, "node").select("id", "topic")
    return ids.join(labelled, "id", "left").select(F.col("id").alias(id_col), F.coalesce("topic", F.lit(NOISE)).alias("topic"))
