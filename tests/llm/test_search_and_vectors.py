"""Exact search and vector near-duplicates against brute force, with odd rows."""

import numpy as np
import pytest

from lexmill.llm import near_dup_vectors, topk

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string"


def vectors(n=300, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    if n < 100:
        return x
    x[50:60] = x[40:50] + 0.05 * rng.standard_normal((10, dim)).astype(np.float32)  # near copies
    x[60:90] = x[0]  # copies
    return x


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], 0, "x") for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [(1000, None, 1, "x"), (1001, [], 1, "x"), (1002, [1.0, None] + [0.0] * 14, 1, "x"), (1003, [float("nan")] * 16, 1, "x"), (1004, [float("inf")] * 16, 1, "x"), (None, [1.0] * 16, 1, "x"), (1005, [1.0, 2.0], 1, "x")]


def brute_top(x, qs, k):
    y = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    out = []
    for q in qs:
        s = y @ y[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
        out += [(q, r + 1, i, int(s[i])) for r, i in enumerate(order)]
    return sorted(out)


def test_top_k_is_exact_with_ties_and_odd_rows(spark):
    x = vectors()
    df = frame(spark, x, ODD)
    got = topk.top_k(df.where("vec_id % 50 = 0 and vec_id < 1000"), df, k=5)
    assert sorted(map(tuple, got.collect())) == brute_top(x, range(0, 300, 50), 5)


@pytest.mark.parametrize("kind", ["skewed", "large", "few"])
def test_search_block_prunes_without_loss(kind):
    rng = np.random.default_rng(3)
    y = rng.integers(-200, 200, (4 if kind == "few" else 2048, 24)).astype(np.int32)
    if kind == "skewed":
        y = (y * np.exp(rng.standard_normal(24) * 2) / 20).astype(np.int32)
    if kind == "large":
        y = y.astype(np.int64) * 2_000_000
    ids, q = np.arange(len(y)) + 5, y[: min(40, len(y))]
    best = dict.fromkeys(range(len(q)), topk.NOTHING)
    for lo in range(0, len(y), 512):
        topk.search_block(ids[: len(q)], q, topk.Lists(ids[lo : lo + 512], y[lo : lo + 512]), best, 5)
    s = y.astype(np.int64) @ q.astype(np.int64).T  # below 2^63
    for i in range(len(q)):
        order = [j for j in np.lexsort((ids, -s[:, i])) if j != i][:5]
        assert best[i][0].tolist() == ids[order].tolist() and best[i][1].tolist() == s[order, i].tolist()


def test_top_k_few_repeated_and_empty(spark):
    x = vectors(4)[:4]
    df = frame(spark, x)
    assert topk.top_k(df.where("vec_id = 0"), df, k=5).count() == 3
    assert topk.top_k(df.where("vec_id = 0"), df.unionAll(df), k=5).count() == 3  # repeated rows are one candidate
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_top_k_large_components(spark):
    x = np.array([[1e7, 1.0], [2e7, 1.0], [3e7, -1.0], [1e7, 2.0]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = topk.top_k(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    y = np.floor(256 * x).astype(np.int64)
    want = [(0, r + 1, i, min(topk.LIMIT, sum(map(int.__mul__, y[0].tolist(), y[i].tolist())))) for r, i in enumerate((2, 1, 3))]
    assert sorted(map(tuple, got.collect())) == want
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(huge.where("vec_id = 0"), huge).collect()]
    assert sorted(got) == [(1, topk.LIMIT), (2, -topk.LIMIT)]


def test_lists_are_read_in_rounds_until_no_outsider_can_qualify(monkeypatch):
    rng = np.random.default_rng(11)
    y = rng.integers(-9, 9, (600, 8))
    monkeypatch.setattr(topk, "FEW", 0.0)  # most queries go to the last round
    best = dict.fromkeys(range(30), topk.NOTHING)
    topk.search_block(np.arange(30), y[:30], topk.Lists(np.arange(600), y), best, 5)
    for i in range(30):
        s = y @ y[i]
        assert best[i][0].tolist() == [j for j in np.lexsort((np.arange(600), -s)) if j != i][:5]


def brute_links(x, cosine):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    a = (u @ u.T >= cosine) & ~np.eye(len(x), dtype=bool)
    comp = np.arange(len(x))
    while True:
        new = np.array([min([comp[i], *comp[a[i]]]) for i in range(len(x))])
        if (new == comp).all():
            return a.sum(axis=1), comp
        comp = new


def test_near_duplicate_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base[i % 40][None] + 0.25 * rng.standard_normal((1, 16)) * (i >= 40) for i in range(400)]).astype(np.float32)  # many pairs near the threshold
    links, comp = brute_links(x, 0.95)
    got = {r["vec_id"]: r for r in near_dup_vectors.near_duplicate_vectors(frame(spark, x, [*ODD, (1006, [0.0] * 16, 1, "x")])).collect()}
    found = sum(got[i]["n_links"] for i in range(400))
    assert all(got[i]["n_links"] <= links[i] for i in range(400))  # none below the threshold
    assert found >= 0.99 * links.sum() and links.sum() > 500
    assert sum(got[i]["component_id"] == comp[i] for i in range(400)) >= 396
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert got[None]["n_links"] == 0


def test_large_group_of_copies_and_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dup_vectors, "BLOCK", 32)  # several blocks in one bucket
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(16)
    x = np.concatenate([np.tile(centre, (50, 1)), centre + 0.02 * rng.standard_normal((150, 16)), rng.standard_normal((60, 16))]).astype(np.float32)
    links, comp = brute_links(x, 0.95)
    got = {r["vec_id"]: r for r in near_dup_vectors.near_duplicate_vectors(frame(spark, x)).collect()}
    assert [got[i]["n_links"] for i in range(260)] == links.tolist()
    assert [got[i]["component_id"] for i in range(260)] == comp.tolist()


def test_vectors_empty_and_repeated_ids(spark):
    assert near_dup_vectors.near_duplicate_vectors(frame(spark, vectors(2)[:0])).count() == 0
    df = frame(spark, vectors(2)[:2])
    rows = near_dup_vectors.near_duplicate_vectors(df.unionAll(df)).collect()
    assert len(rows) == 4 and all(r["n_links"] == 1 for r in rows)
