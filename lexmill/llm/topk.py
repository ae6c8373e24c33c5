"""Exact top-k search by no-random-access aggregation over sorted lists.

Candidates are packed where they are read into blocks of bounded size. A block keeps, for each dimension, its values as
a sorted list, which a query reads from the top where its component is positive and from the bottom where it is negative.
All lists are read in rounds, some more entries each. What is read is added to its candidate's partial score; for what
isn't, the last value read bounds it from above and the list's end from below. A query's threshold is its k-th best lower
bound, or its k-th score so far. It stops when no candidate outside, seen or not, has an upper bound that reaches the
threshold, or when so few do that their final scores are resolved. At the last round everything is read.

Groups of candidate blocks are held by a worker while the queries stream past them, so no pair of blocks is ever a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tuned
from .vectors import rows as usable

K = 5
SCALE = 256
#: Candidates of a block, blocks that a worker holds, and queries that go past them at once.
BLOCK, HELD, QUERIES = 2048, 32, 512
#: How far the lists are read by the end of each round, as shares of their length.
ROUNDS = (0.3, 0.5, 0.7)
#: Candidates left, as a share, at which a query's final scores are resolved.
FEW = 0.02
LIMIT = 2**63 - 1


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), held within 63 bits."""
    y = np.floor(SCALE * x)
    return np.where(np.abs(y) < 2.0**63, y, 0).astype(np.int64) + np.where(y >= 2.0**63, LIMIT, 0) - np.where(y <= -(2.0**63), LIMIT, 0)


def _packed(ids: np.ndarray, y: np.ndarray) -> list:
    """Fields of a block: components take four bytes where all of them fit."""
    y = y.astype(np.int32) if len(y) and max(int(y.max()), -int(y.min())) < 2**31 else y
    return [pa.array([y.shape[1]], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())]


def _unpacked(dim: int, n: int, ids: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vecs, np.int32 if len(vecs) == 4 * n * dim else np.int64).reshape(n, dim)


def _blocks(batches):
    held: dict[int, list] = {}

    def emit(dim):
        ids, vecs = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
        for lo in range(0, len(ids), BLOCK):
            yield pa.RecordBatch.from_arrays(_packed(ids[lo : lo + BLOCK], vecs[lo : lo + BLOCK]), ["dim", "n", "ids", "vecs"])

    for batch in batches:
        ids = batch.column(0)
        for at, x in usable(ids, batch.column(1)):
            dim = x.shape[1]
            held.setdefault(dim, []).append((ids.to_numpy(zero_copy_only=False)[at].astype(np.int64), quantised(x)))
            if sum(len(i) for i, _ in held[dim]) >= BLOCK:
                yield from emit(dim)
    for dim in list(held):
        yield from emit(dim)


NOTHING = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _merge(best, q, ids, scores, rough, k):
    """best[q] with further entries (id, score, size): k distinct ids by score, size, then by smaller id."""
    i, s, f = (np.concatenate(x) for x in zip(best[q], (ids, scores, rough), strict=True))
    order = np.lexsort((i, -f, -s))
    i, s, f = i[order], s[order], f[order]
    if len(np.unique(i)) < len(i):
        first = np.sort(np.unique(i, return_index=True)[1])
        i, s, f = i[first], s[first], f[first]
    best[q] = (i[:k], s[:k], f[:k])


class Lists:
    """A block of candidates with the sorted list of each dimension."""

    def __init__(self, ids: np.ndarray, y: np.ndarray):
        self.ids, self.y, self.sorted = ids, y, np.sort(y, axis=0)
        self.most = float(np.abs(self.sorted[[0, -1]].astype(np.float64)).max(initial=0))
        self.repeats = len(np.unique(ids)) < len(ids)


def _scores(q: np.ndarray, y: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of rows, exact; those that don't fit 63 bits are held at the end of the range, beside their size."""
    if reach < 2**52:
        return np.einsum("ij,ij->i", q.astype(np.float64), y.astype(np.float64)).astype(np.int64), np.zeros(len(q))
    if reach < 2**62:
        return np.einsum("ij,ij->i", q.astype(np.int64), y.astype(np.int64)), np.zeros(len(q))
    exact = [sum(map(int.__mul__, a, b)) for a, b in zip(q.tolist(), y.tolist(), strict=True)]
    return np.array([max(-LIMIT, min(LIMIT, x)) for x in exact], np.int64), np.array([float(x) if abs(x) > LIMIT else 0.0 for x in exact])


def search_block(qids: np.ndarray, q: np.ndarray, block: Lists, best: dict, k: int) -> None:
    """Updates best (query index -> ids, scores, sizes of those beyond 63 bits) with the block's candidates."""
    n, dim = block.y.shape
    reach = np.abs(q.astype(np.float64)).sum(axis=1).max(initial=0) * block.most
    kind = np.float32 if reach < 2**22 else np.float64  # sums are exact below 2^24; beyond 2^53 only nearly
    slack = 0.0 if reach < 2**52 else reach * 1e-9
    y, low, high = block.y.astype(kind), block.sorted[0].astype(kind), block.sorted[-1].astype(kind)
    going = np.arange(len(q))  # queries that haven't stopped
    both = np.concatenate((np.maximum(q, 0).T, np.minimum(q, 0).T)).astype(kind)
    partial = np.zeros((n, len(q)), kind)  # sums of what has been read
    unread = np.ones((n, 2 * dim), bool)  # by the lists' tops, then by their bottoms
    tau = np.array([best[i][1][k - 1] if len(best[i][1]) >= k else -np.inf for i in going])
    for depth in (*ROUNDS, 1.0):
        t = max(1, int(depth * n))
        last = np.concatenate((block.sorted[n - t], block.sorted[t - 1])).astype(kind)
        now = unread & np.concatenate((y >= last[:dim], y <= last[dim:]), axis=1)
        partial += np.where(now, np.concatenate((y, y), axis=1), 0) @ both
        unread &= ~now
        left = unread.astype(kind)
        if np.isneginf(tau).any() and not block.repeats and n > k:
            under = partial + left @ (np.concatenate((low, high))[:, None] * both)
            under[block.ids[:, None] == qids[going][None, :]] = -np.inf
            tau = np.maximum(tau, np.partition(under, n - k, axis=0)[n - k] - slack)
        alive = partial + left @ (last[:, None] * both) + slack >= tau
        count = np.count_nonzero(alive, axis=0)
        stop = np.full(len(going), True) if depth == 1.0 else count <= max(FEW * n, 4 * k)
        if stop.any():
            alive &= stop
            c, j = np.nonzero(alive.T)[::-1]  # by query
            other = block.ids[c] != qids[going[j]]
            c, j = c[other], j[other]
            step = range(0, len(c), 1 << 16)
            score, rough = (np.concatenate(x) for x in zip(NOTHING[1:], *(_scores(q[going[j[lo : lo + (1 << 16)]]], block.y[c[lo : lo + (1 << 16)]], reach) for lo in step), strict=True))
            edge = np.searchsorted(j, np.arange(len(going) + 1))
            for x, i in enumerate(going.tolist()):
                own = slice(edge[x], edge[x + 1])
                ci, si, fi = block.ids[c[own]], score[own], rough[own]
                if len(best[i][0]) >= k:
                    good = si >= best[i][1][k - 1]
                    ci, si, fi = ci[good], si[good], fi[good]
                if len(ci):
                    _merge(best, i, ci, si, fi, k)
            going, tau, partial, both = going[~stop], tau[~stop], partial[:, ~stop], both[:, ~stop]
            if not len(going):
                return


def _search(k: int):
    """Rows (dim, side, n, ids, vecs) of one group after another, candidates before queries."""
    def run(batches):
        held: list[Lists] = []
        place, side, waiting = None, None, []

        def answer():
            qids, q = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            for lo in range(0, len(qids), QUERIES):
                own, some = qids[lo : lo + QUERIES], q[lo : lo + QUERIES]
                best = dict.fromkeys(range(len(own)), NOTHING)
                for block in held:
                    search_block(own, some, block, best, k)
                n = [len(best[i][0]) for i in range(len(own))]
                found = [pa.array(np.concatenate([best[i][c] for i in range(len(own))])) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), *found], ["query_id", "vec_id", "score", "size"])

        for batch in batches:
            for r in range(batch.num_rows):
                g, dim, is_query, n, ids, vecs = (batch.column(c)[r].as_py() for c in range(6))
                if (g, dim) != place or (side and not is_query):
                    if waiting:
                        yield from answer()
                    place, held = (g, dim), []
                side = is_query
                if not is_query:
                    held.append(Lists(*_unpacked(dim, n, ids, vecs)))
                elif held:
                    waiting.append(_unpacked(dim, n, ids, vecs))
                    if sum(len(x) for x, _ in waiting) >= QUERIES:
                        yield from answer()
        if waiting:
            yield from answer()
    return run


def top_k(queries: DataFrame, candidates: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score): for each query the k candidates of highest integer inner product.

    Components count as floor(256 * x), held within 63 bits. A score that doesn't fit 63 bits is held at the end of the
    range, and such scores rank by their value as a double. Candidates with the query's own id don't count; ties go to the smaller id; fewer candidates give fewer rows.
    Null ids and vectors that are null, empty or hold null or non-finite components take no part, and vectors of another
    length don't meet. Rows that share an id are one candidate with its best score, and one query likewise. Other
    columns aren't read; empty tables give no rows.
    """
    spark = tuned(candidates.sparkSession)
    kind = "dim int, n int, ids binary, vecs binary"
    pick = lambda df: df.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"))
    c = cut(pick(candidates).mapInArrow(_blocks, kind).withColumn("b", F.monotonically_increasing_id()))
    n = c.agg(F.sum("n")).first()[0] or 0
    groups = max(2 * spark.sparkContext.defaultParallelism, -(-n // (HELD * BLOCK)))
    c = c.withColumn("g", F.pmod(F.xxhash64("b"), F.lit(groups)))
    q = pick(queries).mapInArrow(_blocks, kind).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    fields = lambda df, side: df.select("g", "dim", F.lit(side).alias("is_query"), "n", "ids", "vecs")
    met = fields(c, False).unionByName(fields(q, True)).repartition("g", "dim").sortWithinPartitions("g", "dim", "is_query")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long, size double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("size").alias("size"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("size"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(vectors: DataFrame) -> DataFrame:
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS y
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.y AS DOUBLE[]), CAST(c.y AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
