"""Density clusters: blobs of different density, noise, odd rows."""

import numpy as np
import pytest

from lexmill import models as M
from lexmill.functions.graph import components
from lexmill.operators import density as D
from lexmill.operators import vocabulary as V
from lexmill.sources import readers


def blobs(n=40, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(c * n + i, (np.eye(6)[c] + rng.normal(0, 0.02 + 0.03 * c, 6)).tolist()) for c in range(3) for i in range(n)]
    return rows + [(1000 + i, rng.normal(0, 1, 6).tolist()) for i in range(8)]


def test_blobs_are_clusters_and_strays_noise(spark, tmp_path):
    df = spark.createDataFrame([*blobs(), (2000, None)], "doc_id long, embedding array<double>")
    got = {r["doc_id"]: r["topic"] for r in D.density_clusters(df, 15, 5).collect()}
    assert len(got) == 129 and got[2000] == -1
    for c in range(3):
        own = [got[c * 40 + i] for i in range(40)]
        lead = max(set(own) - {-1}, key=own.count)
        assert own.count(lead) >= 28
    assert len({t for t in got.values() if t >= 0}) == 3
    rows = blobs()
    plain = plain_clusters(np.array([x for _, x in rows]), 5, 15)
    assert partition([got[i] for i, _ in rows]) == partition(plain)


def plain_tree(x, k):
    """All edges of the mutual-reachability graph, by Kruskal: (w, a, b)."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(np.maximum(1 - u @ u.T, 0), D.PLACES)
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, k - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    i, j = np.triu_indices(len(x), 1)
    up = np.arange(len(x))

    def find(p):
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        return p

    out = []
    for e in np.lexsort((j, i, w[i, j])):
        a, b = find(i[e]), find(j[e])
        if a != b:
            up[a] = b
            out.append((float(w[i[e], j[e]]), int(i[e]), int(j[e])))
            if len(out) == len(x) - 1:
                break
    return out


def plain_clusters(x, k, least):
    """From the whole downwards: edges leave from the longest; a part smaller than least falls out of its cluster."""
    n, tree = len(x), plain_tree(x, k)
    size, kids, up = [1] * n, [None] * n, list(range(2 * n - 1))

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    for w, a, b in tree:
        a, b = find(a), find(b)
        up[a] = up[b] = len(size)
        size.append(size[a] + size[b])
        kids.append((a, b, w))

    def leaves(c):
        stack, out = [c], []
        while stack:
            p = stack.pop()
            out += [p] if p < n else []
            stack += list(kids[p][:2]) if p >= n else []
        return out

    clusters = []  # [born, stays, parts, members]

    def follow(c, born):
        own = [born, 0.0, [], leaves(c)]
        clusters.append(own)
        me = len(clusters) - 1
        while True:
            a, b, w = kids[c]
            density = 1 / max(w, D.LEAST)
            big = [p for p in (a, b) if size[p] >= least]
            if len(big) == 2 or not big:
                own[1] += size[c] * (density - born)
                own[2] = [follow(p, density) for p in big]
                return me
            own[1] += size[b if big == [a] else a] * (density - born)
            c = big[0]

    import sys
    sys.setrecursionlimit(10000)
    follow(2 * n - 2, 0.0)
    worth, best = {}, {}
    for c in reversed(range(len(clusters))):
        below = sum(worth[p] for p in clusters[c][2])
        best[c] = c > 0 and (not clusters[c][2] or clusters[c][1] >= below)
        worth[c] = max(clusters[c][1], below) if c else below
    label, stack = np.full(n, -1), [0]
    while stack:
        c = stack.pop()
        if best[c]:
            label[clusters[c][3]] = c
        else:
            stack += clusters[c][2]
    return label


def partition(labels):
    found = {}
    for i, t in enumerate(labels):
        found.setdefault(t, []).append(i)
    return sorted(found.pop(-1, [])), sorted(found.values())


def cloud(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, 5))
    x = centres[rng.integers(7, size=n)] + rng.normal(size=(n, 5)) * rng.choice([0.05, 0.15, 0.4], size=n)[:, None]
    x[: n // 10] = rng.normal(size=(n // 10, 5))
    return x


@pytest.mark.parametrize("n,k,least,chunk", [(250, 3, 5, 40), (2000, 5, 20, 10_000)])
def test_labels_equal_those_of_all_pairs(spark, n, k, least, chunk):
    x = cloud(n, n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>").repartition(3)
    tree = sorted((r["w"], r["a"], r["b"]) for r in D.spanning_tree(df, k).collect())
    assert np.allclose([t[0] for t in tree], sorted(t[0] for t in plain_tree(x, k)), atol=1e-11)
    got = {r["doc_id"]: r["topic"] for r in D.density_clusters(df, least, k, chunk=chunk).collect()}
    want = partition(plain_clusters(x, k, least))
    assert len(want[1]) > 2
    assert partition([got[i] for i in range(n)]) == want


def test_equal_vectors_and_odd_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(12)] + [(20 + i, [0.0, 1.0]) for i in range(12)] + [(50, None), (51, [float("nan"), 1.0]), (None, [1.0, 1.0]), (3, [1.0, 0.0])]
    got = D.density_clusters(spark.createDataFrame(rows, "doc_id long, embedding array<double>"), 5, 3).collect()
    by = {r["doc_id"]: r["topic"] for r in got}
    assert len(got) == len(rows) and by[50] == by[51] == by[None] == -1
    assert {by[i] for i in range(12)} == {0} and {by[20 + i] for i in range(12)} == {1}


def test_empty_and_one_cloud(spark):
    kind = "doc_id long, embedding array<double>"
    assert D.density_clusters(spark.createDataFrame([], kind), 3, 2).count() == 0
    one = D.density_clusters(spark.createDataFrame([(i, [1.0, i / 1000]) for i in range(6)], kind), 10, 2)
    assert {r["topic"] for r in one.collect()} == {-1}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (None, 1), (5, 5)], "a long, b long")
    assert sorted(map(tuple, components(e).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]


def test_bertopic_by_density(spark, tmp_path):
    rows = blobs()
    texts = readers.from_texts(spark, [f"word{'abc'[min(i // 40, 2)]} word{'abc'[min(i // 40, 2)]}" for i in range(120)])
    e = spark.createDataFrame(rows[:120], "doc_id long, embedding array<double>")
    m = M.BERTopic(min_cluster=15, reduce_to=2).fit(V.corpus(texts.select("doc_id", "text")), e)
    assert {r["topic"] for r in m.info().collect()} - {-1} == {0, 1}
    m.save(str(tmp_path / "m"))
    assert M.BERTopic.load(spark, str(tmp_path / "m")).info().count() == m.info().count()
