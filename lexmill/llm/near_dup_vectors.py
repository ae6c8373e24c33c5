"""Embedding near-dedup by counting collisions of one-dimensional projections.

Unit vectors are projected on random lines. In each of several tables a few projections, cut into shifted cells, key a
bucket, and one more projection sorts the bucket's members. A window centred at each member, as wide as vectors of the
threshold's distance need, gives its partners there. For each pair the collisions of 32 further projections (differences
within the window) are counted; pairs with fewer than a count calibrated for the wanted recall are dropped, and the rest
is verified by its cosine in double precision.

Copies are one class from the start. Only keys, sorters and one byte for each counted projection are shuffled; vectors
follow for those members alone that have a partner with enough collisions. Buckets beyond a bounded size are cut into
blocks that meet pairwise. A pair counts in the first table where it meets, which both vectors show, so pairs are never
emitted or de-duplicated: a task returns only each member's number of links and one edge to its local component's root.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, roots, small, tuned
from .vectors import rows as usable

COSINE = 0.95
#: Counted projections, and the half-width of a window in standard deviations of a pair at the threshold.
COUNTED, REACH = 32, 2.0
#: Shares of the pairs at the threshold that counting and the tables may each lose.
MISS_COUNT, MISS_TABLES = 1e-3, 1e-2
#: Cell width in standard deviations of unit vectors' projections, the share of unrelated vectors that a cell joins, the
#: unrelated members that a bucket may have on average, and the members that a bucket's block may hold.
CELL, JOINED, CROWD, BLOCK = 2.0, 0.5, 128, 1024
SEED = 71
#: Steps of a counted projection in a window, and bits for the number of a table.
STEPS, BITS = 6, 12


def _normal(z: float) -> float:
    return math.erf(z / math.sqrt(2))


class Plan:
    """Projections, windows and counts for vectors of one dimension; the same for every task."""

    def __init__(self, dim: int, rows: int, cosine: float = COSINE):
        self.dim, self.cosine = dim, cosine
        far = math.sqrt(max(2 - 2 * cosine, 1e-12) / dim)  # sd of a threshold pair's difference on one line
        self.width = REACH * far
        self.cell = max(CELL / math.sqrt(dim), 2 * far)
        near = 1 - math.sqrt(2 / math.pi) * far / self.cell
        # cells in a key: so many that unrelated vectors seldom share a bucket
        self.keyed = max(2, min(24, round(math.log(max(rows / CROWD, 1)) / math.log(1 / JOINED))))
        share = near**self.keyed * _normal(REACH)
        self.tables = max(4, math.ceil(math.log(MISS_TABLES) / math.log(1 - share)))
        p, lost, c = _normal(REACH), 0.0, 0
        while c <= COUNTED and lost + (step := math.comb(COUNTED, c) * p**c * (1 - p) ** (COUNTED - c)) < MISS_COUNT:
            lost, c = lost + step, c + 1
        self.least = c
        rng = np.random.default_rng([SEED, dim])
        unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((n, dim)))
        self.lines, self.sorters, self.counters = unit(self.tables * self.keyed), unit(self.tables), unit(COUNTED)
        self.shift = rng.random(self.tables * self.keyed) * self.cell
        self.odd = rng.integers(1, 2**62, size=(self.tables, self.keyed), dtype=np.int64) | 1

    def tags(self) -> np.ndarray:
        """The numbers of the tables, with the dimension."""
        return ((self.dim << BITS) + np.arange(self.tables)).astype(np.int32)

    def keys(self, u: np.ndarray) -> np.ndarray:
        cells = np.floor((_project(u, self.lines) + self.shift) / self.cell).astype(np.int64).reshape(len(u), self.tables, self.keyed)
        h = (cells * self.odd).sum(axis=2)
        return (h ^ (h >> 29)) * 0x5DEECE66D1

    def order(self, u: np.ndarray) -> np.ndarray:
        return _project(u, self.sorters).astype(np.float32)

    def counts(self, u: np.ndarray) -> np.ndarray:
        """The counted projections in steps of a sixth of a window, held to one byte."""
        return np.clip(np.floor(_project(u, self.counters) * (STEPS / self.width)) + 128, 0, 255).astype(np.uint8)


def _project(u: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Inner products summed in one order whatever the number of rows, so that every task finds the same cells."""
    return np.einsum("ij,kj->ik", u, lines)


def _rows(batches):
    """(id, dim, v) of every row; v is null for vectors that take no part."""
    for batch in batches:
        ids = batch.column(0)
        dims, out = np.zeros(len(ids), np.int32), [None] * len(ids)
        for at, x in usable(ids, batch.column(1)):
            x = x + 0.0  # no negative zero
            live = np.abs(x).max(axis=1) > 0
            at, x = at[live], x[live]
            short = x.astype(np.float32)
            dims[at] = x.shape[1]
            for i, f, a, b in zip(at.tolist(), (short == x).all(axis=1), short, x, strict=True):
                out[i] = (a if f else b).tobytes()
        yield pa.RecordBatch.from_arrays([ids, pa.array(dims), pa.array(out, pa.binary())], ["id", "dim", "v"])


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """float64 rows from vectors kept in four bytes a component where that is exact, else in eight."""
    out = np.empty((len(raw), dim))
    short = np.array([len(v) == 4 * dim for v in raw])
    for kind, at in ((np.float32, np.flatnonzero(short)), (np.float64, np.flatnonzero(~short))):
        if len(at):
            out[at] = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(-1, dim)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dim(plans: dict[int, Plan], dims: np.ndarray, raw: list[bytes]):
    """For each dimension: its plan, its rows' places and their unit vectors."""
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield plans[dim], at, _unit(_matrix([raw[i] for i in at], dim))


def _keys(plans: dict[int, Plan]):
    def run(batches):
        for batch in batches:
            for plan, at, u in _by_dim(plans, batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(plan.tags(), len(at))), pa.array(plan.keys(u).ravel())], ["dt", "key"])
    return run


def _table_rows(plans: dict[int, Plan]):
    def run(batches):
        for batch in batches:
            node = batch.column(2).to_numpy()
            for plan, at, u in _by_dim(plans, batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                w = np.repeat(np.arange(len(at)), plan.tables)
                counts = pa.array([c.tobytes() for c in plan.counts(u)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(plan.tags(), len(at))), pa.array(plan.keys(u).ravel()), pa.array(plan.order(u).ravel()),
                                                  pa.array(node[at][w]), counts.take(pa.array(w))], ["dt", "key", "s", "node", "counts"])
    return run


GROUP = ("dt", "key", "blk")


def _groups(batches):
    """Tables of whole groups from rows sorted by GROUP."""
    held: list[pa.RecordBatch] = []
    tail = lambda b, k: tuple(b.column(c)[k].as_py() for c in GROUP)
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        end = tail(batch, batch.num_rows - 1)
        if tail(held[0], 0) == end:
            continue
        table = pa.Table.from_batches(held)
        inside = np.logical_and.reduce([table.column(c).to_numpy() == e for c, e in zip(GROUP, end, strict=True)])
        start = int(inside.argmax())
        if start:
            yield table.slice(0, start).combine_chunks()
        held = table.slice(start).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _parts(plans: dict[int, Plan], table: pa.Table):
    """For each dimension: its plan, its rows, their group numbers, tables, whether blocks differ, and their side."""
    dt, key, blk = (table.column(c).to_numpy() for c in GROUP)
    group = np.cumsum(np.r_[True, (dt[1:] != dt[:-1]) | (key[1:] != key[:-1]) | (blk[1:] != blk[:-1])])
    right = table.column("right").to_numpy(zero_copy_only=False)
    for dim in np.unique(dt >> BITS).tolist():
        at = np.flatnonzero(dt >> BITS == dim)
        yield plans[dim], at, group[at], dt[at] & ((1 << BITS) - 1), (blk[at] >> 31) != (blk[at] & (2**31 - 1)), right[at]


def _window_pairs(g, s, two, right, width):
    """Pairs (p, q) of places within a group whose sorters lie within the window; s ascends within groups."""
    i, o = np.arange(len(g) - 1), 1
    while len(i):
        j = i + o
        i = i[(g[i] == g[j]) & (s[j] - s[i] <= width)]  # sorted: who has left the window stays out
        p = i[~two[i] | (right[i] != right[i + o])]
        if len(p):
            yield p, p + o
        o += 1
        i = i[i + o < len(g)]


def _survivors(plans: dict[int, Plan]):
    """Rows sorted by (*GROUP, s): the members with a partner in the window that collides often enough."""
    def run(batches):
        for table in _groups(batches):
            s, keep = table.column("s").to_numpy(), np.zeros(table.num_rows, bool)
            for plan, at, g, _, two, right in _parts(plans, table):
                counts = np.frombuffer(b"".join(table.column("counts").take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, COUNTED).astype(np.int16)
                for p, q in _window_pairs(g, s[at], two, right, plan.width):
                    new = ~(keep[at[p]] & keep[at[q]])
                    p, q = p[new], q[new]
                    ok = (np.abs(counts[p] - counts[q]) <= STEPS + 1).sum(axis=1) >= plan.least
                    keep[at[p[ok]]] = keep[at[q[ok]]] = True
            yield from table.select([*GROUP, "right", "node"]).filter(pa.array(keep)).combine_chunks().to_batches()
    return run


def _links(plans: dict[int, Plan], cosine: float):
    """Rows sorted by GROUP: (node, links to add, root) of members with links."""
    def run(batches):
        for table in _groups(batches):
            node, size, raw = table.column("node").to_numpy(), table.column("size").to_numpy(), table.column("v")
            for plan, at, g, t, two, right in _parts(plans, table):
                v = _unit(_matrix(raw.take(pa.array(at)).to_pylist(), plan.dim))
                keys, sorters, counts = plan.keys(v), plan.order(v), plan.counts(v).astype(np.int16)
                s = sorters[np.arange(len(at)), t]
                by = np.lexsort((s, g))
                at, g, t, two, right, v, keys, sorters, counts, s = (x[by] for x in (at, g, t, two, right, v, keys, sorters, counts, s))
                left, other = [], []
                for p, q in _window_pairs(g, s, two, right, plan.width):
                    ok = (np.abs(counts[p] - counts[q]) <= STEPS + 1).sum(axis=1) >= plan.least
                    p, q = p[ok], q[ok]
                    ok = np.einsum("ij,ij->i", v[p], v[q]) >= cosine
                    p, q = p[ok], q[ok]
                    if len(p):
                        met = (keys[p] == keys[q]) & (np.abs(sorters[p] - sorters[q]) <= np.float32(plan.width))
                        ok = met.argmax(axis=1) == t[p]
                        left.append(p[ok])
                        other.append(q[ok])
                if not left:
                    continue
                a, b = np.concatenate(left), np.concatenate(other)
                r, n = node[at], size[at]
                add = np.bincount(a, n[b], len(at)) + np.bincount(b, n[a], len(at))
                hit = np.flatnonzero(add > 0)
                yield pa.RecordBatch.from_arrays([pa.array(r[hit]), pa.array(add[hit].astype(np.int64)), pa.array(r[roots(len(at), a, b)[hit]])], ["node", "add", "root"])
    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one for each row of vectors.

    Two vectors are linked if their cosine in double precision is at least the threshold. n_links counts the other
    vectors linked directly, copies each; component_id is the least id reachable by links, kept says that it is the
    row's own. Vectors that are null, empty or zero, hold null or non-finite components, or have a null id link with
    nothing; vectors of different lengths don't meet. Rows that share an id count as so many vectors. Other columns
    aren't read; no rows: no rows. At the threshold at least 99 % of the links are found, closer ones more surely.
    """
    tuned(vectors.sparkSession)
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    raw = cut(src.mapInArrow(_rows, "id long, dim int, v binary"))
    classes = cut(raw.where("v is not null").groupBy("dim", "v").agg(F.min("id").alias("rep"), F.count("*").alias("size")).withColumn("node", F.monotonically_increasing_id()))
    plans = {r["dim"]: Plan(r["dim"], r["count"], cosine) for r in classes.groupBy("dim").count().collect()}  # a row a dimension
    # buckets that need several blocks are few, and known before the rows are shuffled
    sizes = classes.select("dim", "v").mapInArrow(_keys(plans), "dt int, key long").groupBy("dt", "key").agg(F.count("*").alias("m"))
    large = cut(sizes.where(F.col("m") > BLOCK).select("dt", "key", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int").alias("nb")))
    rows = classes.select("dim", "v", "node").mapInArrow(_table_rows(plans), "dt int, key long, s float, node long, counts binary")
    rows = rows.join(small(large, width=24), ["dt", "key"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    side = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    rows = rows.withColumn("side", side).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    blk = F.shiftleft(F.least("side", "o").cast("long"), 31).bitwiseOR(F.greatest("side", "o").cast("long"))
    rows = rows.select("dt", "key", blk.alias("blk"), (F.col("side") > F.col("o")).alias("right"), "s", "node", "counts")
    near = cut(rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "s").mapInArrow(_survivors(plans), "dt int, key long, blk long, right boolean, node long"))
    near = near.join(classes.select("node", "size", "v"), "node")
    found = cut(near.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_links(plans, cosine), "node long, add long, root long"))
    links = found.groupBy("node").agg(F.sum("add").alias("add"))
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).toDF("node", "c")
    # a class is known by two hashes of its vector from here on
    print_ = lambda df: df.withColumns({"h1": F.xxhash64("dim", "v"), "h2": F.xxhash64(F.lit("second"), "dim", "v")}).drop("dim", "v")
    known = print_(classes).join(links, "node", "left").join(comp, "node", "left").withColumn("c", F.coalesce("c", "node"))
    least = known.groupBy("c").agg(F.min("rep").alias("component"))
    known = known.join(least, "c").select("h1", "h2", (F.coalesce("add", F.lit(0)) + F.col("size") - 1).alias("n"), "component")
    live = F.col("v").isNotNull()
    out = print_(raw.withColumn("live", live)).join(known, ["h1", "h2"], "left")
    own = F.when(F.col("live"), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id").eqNullSafe(own), F.lit(False)).alias("kept"))


def op7(vectors: DataFrame) -> DataFrame:
    return near_duplicate_vectors(vectors)


ORACLE = """
WITH RECURSIVE u AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS c FROM u UNION SELECT l.b, r.c FROM reach r JOIN links l ON r.id = l.a),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, v.vec_id) AS component_id, coalesce(c.c, v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN comp c ON v.vec_id = c.id LEFT JOIN n ON n.a = v.vec_id
"""
