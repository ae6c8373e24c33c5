"""The sampler: planted topics, the table of assignments, skewed words, draws and their diagnostics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import models as M
from lexmill.models import gibbs
from lexmill.operators import compare
from lexmill.sources import readers
from tests.test_models import blocks, planted, simplex


@pytest.fixture(scope="module")
def fitted(spark):
    docs = readers.from_tokens(spark, [[*d, "common", "common"] for d in planted(n=150, length=20)]).persist()
    corpus = M.Corpus(docs, max_df=0.9)
    w = M.WarpLDA(3, alpha=0.3, iters=45, seed=1, draws=3, thin=2)
    return docs, corpus, w, w.fit(corpus)


def test_planted_topics_are_found(fitted):
    docs, corpus, w, m = fitted
    simplex(m)
    assert len(blocks(m.top_words())) == 3
    h = [x for _, x in m.fit_history]
    assert h[-1] > h[0] and len(w.samples) == 3


def test_tables_are_the_assignments(spark, fitted):
    docs, corpus, w, m = fitted
    a = w.assignments
    assert a.groupBy("doc_id", "i").agg(F.sum("n").alias("n")).exceptAll(corpus.rows.select("doc_id", F.explode(F.arrays_zip("i", "n")).alias("x")).select("doc_id", "x.i", F.col("x.n").cast("long"))).count() == 0
    counts = np.full((3, corpus.size), 0.01)
    for r in a.collect():
        counts[r["topic"], r["i"]] += r["n"]
    assert np.allclose(m.topic_word, counts / counts.sum(axis=1, keepdims=True))
    theta = {(r["doc_id"], r["topic"]): r["p"] for r in m.theta.collect()}
    n = {}
    for r in a.collect():
        n[r["doc_id"], r["topic"]] = n.get((r["doc_id"], r["topic"]), 0) + r["n"]
    for (d, t), p in theta.items():
        assert p == pytest.approx((n.get((d, t), 0) + 0.3) / (sum(n.get((d, k), 0) for k in range(3)) + 0.9))


def test_chain_diagnostics(fitted):
    chain = np.array([[x for _, x in fitted[3].fit_history][20:]])
    assert compare.ess(chain) > 1


def test_word_of_a_third_of_all_tokens(spark):
    docs = readers.from_tokens(spark, [d + ["the"] * 10 for d in planted(n=120, length=20)])
    w = M.WarpLDA(3, alpha=0.3, iters=60, seed=1)
    m = w.fit(M.Corpus(docs))
    assert len({max("012", key=lambda b, ws=ws: sum(x.startswith(f"w{b}") for x in ws)) for ws in m.top_words()}) == 3
    assert w.assignments.agg(F.sum("n")).first()[0] == 120 * 30


def test_same_seed_same_draws(spark):
    docs = readers.from_tokens(spark, planted(n=30))
    a, b = (M.WarpLDA(3, iters=5, seed=9).fit(M.Corpus(docs)).fit_history for _ in range(2))
    assert a == b


def test_side_keeps_its_target():
    """Long runs over one row visit topics as often as the target says."""
    rng, k = np.random.default_rng(0), 3
    row, z, totals = np.zeros(4000, int), rng.integers(k, size=4000), np.array([100.0, 200.0, 400.0])
    z[:] = np.repeat([0, 1, 2], [2000, 1000, 1000])
    proposed = rng.integers(k, size=(4000, 200))
    new, out, _ = gibbs.side(row, z.copy(), proposed, 0.5, totals, k, rng)
    want = (np.array([2000, 1000, 1000]) + 0.5) / totals
    assert np.allclose(np.bincount(new, minlength=k) / 4000, want / want.sum(), atol=0.03)
    assert np.allclose(np.bincount(out[:, 0], minlength=k) / 4000, np.bincount(new, minlength=k) / 4000, atol=0.03)


def test_counts_dense_and_sorted(monkeypatch):
    rng = np.random.default_rng(1)
    row, z = rng.integers(50, size=1000), rng.integers(7, size=1000)
    a = gibbs.Counts(row, z, 50, 7)
    monkeypatch.setattr(gibbs, "DENSE", 1)
    b = gibbs.Counts(row, z, 50, 7)
    r, t = rng.integers(50, size=500), rng.integers(7, size=500)
    assert (a.of(r, t) == b.of(r, t)).all() and sorted(a.live()) == sorted(b.live())
    assert gibbs.log_rising(np.array([0, 1, 3]), 0.5) == pytest.approx(np.log(0.5) + np.log(0.5 * 1.5 * 2.5))
