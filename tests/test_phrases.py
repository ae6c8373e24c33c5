"""Topical n-grams: planted phrases, the chain against all paths."""

import itertools

import numpy as np

from lexmill import models as M
from lexmill.models import phrases
from lexmill.sources import readers
from tests.test_models import simplex


def test_chain_equals_all_paths():
    rng, k, v = np.random.default_rng(0), 2, 4
    w, b = rng.integers(v, size=(5, 3)), rng.integers(-1, 3, size=(5, 3))
    b[0] = -1
    size = np.array([5, 4, 2])
    theta, phi, sigma, psi = rng.dirichlet(np.ones(k), 3), rng.random((v, k)), rng.random((3, k)), rng.random((v, k))
    topic, carried, before, like = phrases.chain(w, b, size, theta, phi, sigma, psi)
    for d, n in enumerate(size):
        total, z_mass, on_mass, past = 0.0, np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
        for z in itertools.product(range(k), repeat=int(n)):
            for x in itertools.product((0, 1), repeat=int(n)):
                p = 1.0
                for t in range(n):
                    go = psi[w[t - 1, d], z[t - 1]] if t and b[t, d] >= 0 else 0.0
                    p *= theta[d, z[t]] * (go * sigma[b[t, d], z[t]] if x[t] else (1 - go) * phi[w[t, d], z[t]])
                total += p
                for t in range(n):
                    z_mass[t, z[t]] += p
                    if x[t]:
                        on_mass[t, z[t]] += p
                        past[t, z[t - 1]] += p
        assert np.isclose(like[d], np.log(total))
        assert np.allclose(topic[:n, d], z_mass / total) and np.allclose(carried[:n, d], on_mass / total) and np.allclose(before[:n, d], past / total)


def test_planted_phrases_are_found(spark):
    rng, docs = np.random.default_rng(1), []
    for i in range(120):
        words = [f"w{i % 2}{rng.integers(8)}x" for _ in range(24)]
        for at in sorted(rng.choice(20, 4, replace=False))[::-1]:
            words[at:at] = [["new", "york", "city"], ["machine", "learning"]][i % 2]
        docs.append(words)
    m = M.TopicalNGrams(2, seed=2, iters=40)
    model = m.fit(readers.from_tokens(spark, docs))
    simplex(model)
    assert model.fit_history[-1][1] > model.fit_history[0][1]
    found = {}
    for r in m.phrases().collect():
        found[r["phrase"]] = max(found.get(r["phrase"], (0, 0)), (r["n"], r["topic"]))
    assert found["new york city"][0] > 200 and found["machine learning"][0] > 200
    assert found["new york city"][1] != found["machine learning"][1]
    assert sum(n for p, (n, _) in found.items() if p not in ("new york city", "machine learning")) < 60


def test_documents_without_pairs(spark):
    model = M.TopicalNGrams(2, iters=3).fit(readers.from_tokens(spark, [["a"], ["b"], ["a", "c"]]))
    assert model.theta.count() == 6


def test_runs_equal_whole_documents():
    rng, k, v = np.random.default_rng(3), 3, 6
    size = np.array([40, 23, 1, 17])
    w, own = rng.integers(v, size=size.sum()), np.repeat(np.arange(4), size)
    b = np.where(rng.random(len(w)) < 0.6, rng.integers(0, 5, len(w)), -1)
    b[np.cumsum(size) - size] = -1
    phi, sigma, psi = rng.random((v, k)), rng.random((5, k)), rng.random((v, k))
    alone, single, tied, *posts, like, theta = phrases.settle(w, b, own, 4, 0.1, phi, sigma, psi)
    topic, carried, before = np.zeros((3, len(w), k))
    topic[alone], topic[tied], carried[tied], before[tied] = single.T, *posts
    assert len(alone) and len(tied) and len(alone) + len(tied) == len(w)
    together, last = 0.0, np.full((4, k), 1 / k)
    for d in range(4):
        at = own == d
        for _ in range(phrases.INNER):
            x, y, z, one = (a[:, 0] if a.ndim == 3 else a[0] for a in phrases.chain(w[at][:, None], b[at][:, None], size[d : d + 1], last[d : d + 1], phi, sigma, psi))
            last[d] = (x.sum(axis=0) + 0.1) / (x.sum(axis=0) + 0.1).sum()
        assert all(np.allclose(p, q, atol=1e-5) for p, q in ((topic[at], x), (carried[at], y), (before[at], z), (theta[d], last[d])))
        together += one
    assert np.isclose(like, together, rtol=1e-5)


def test_a_document_takes_as_many_steps_as_its_longest_run():
    b = np.zeros(30_000, np.int64)
    b[::3] = -1
    groups = list(phrases.runs(b, 6))
    assert all(len(at) == 3 for at, _ in groups) and sum(len(size) for _, size in groups) == 10_000


def test_all_frequent_pairs_are_held(spark):
    m = M.TopicalNGrams(2, iters=1, min_pair=2)
    m.fit(readers.from_tokens(spark, [[f"w{i}x", f"w{j}x"] for i in range(6) for j in range(6)] * 2))
    assert not hasattr(phrases, "MAX_PAIRS") and len(m.pairs) == m.pair_counts.count() == 36
