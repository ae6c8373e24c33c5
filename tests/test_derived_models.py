"""Models built on others, on planted corpora."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import blocks, planted, simplex

from lexmill import models as M
from lexmill.models.derived import legendre, smooth_on_tree
from lexmill.sources import readers


def test_gdmr(spark):
    d = readers.from_tokens(spark, planted(2)).withColumn("t", F.when(F.col("doc_id") % 2 == 0, -0.8).otherwise(0.8))
    m = M.GDMR(2, {"t": (-1.0, 1.0)}, degree=2, iters=8, seed=1)
    simplex(m.fit(M.Corpus(m.basis(d), carry=m.carry)))
    assert abs(m.curve({"t": -0.8})[0] - m.curve({"t": 0.8})[0]) > 0.3
    row = d.select(*legendre("t", -1.0, 1.0, 3)).first()
    assert np.allclose(list(row), [np.polynomial.legendre.legval(-0.8, np.eye(4)[n]) for n in (1, 2, 3)])


def test_disclda(spark):
    d = readers.from_tokens(spark, [[*t, "common"] for t in planted(2)]).withColumn("y", F.concat(F.lit("c"), (F.col("doc_id") % 2).cast("string")))
    m = M.DiscLDA(["c0", "c1"], own=1, shared=1, iters=12, seed=1)
    fit = m.fit(M.Corpus(d, carry=m.carry))
    simplex(fit)
    assert [fit.top_words()[i][0][:2] for i in (0, 1)] == ["w0", "w1"]
    assert fit.theta.where("doc_id % 2 = 0 and topic = 1").agg(F.max("p")).first()[0] < 1e-6


def test_author_recipient(spark):
    d = readers.from_tokens(spark, planted(2)).withColumns({"author": F.lit("ann"), "recipients": F.array(F.when(F.col("doc_id") % 2 == 0, "bob").otherwise("cy"))})
    m = M.AuthorRecipientTopic(2, iters=40, seed=1)
    m.fit(M.Corpus(m.pairs(d), carry=("authors",)))
    assert m.authors == ["ann>bob", "ann>cy"] and m.author_topic.argmax(axis=1).tolist() in ([0, 1], [1, 0])


def test_embedding_lda(spark):
    rng = np.random.default_rng(0)
    wv = {f"w{b}{j}x": np.eye(3)[b] + 0.05 * rng.standard_normal(3) for b in range(3) for j in range(8)}
    fit = M.EmbeddingLDA(3, wv, top_n=4, iters=10).fit(M.Corpus(readers.from_tokens(spark, planted())))
    assert len(blocks(fit.top_words())) == 3


def test_trees(spark):
    theta = spark.createDataFrame([(d, t, p) for d, ps in {0: (1.0, 0.0), 1: (0.0, 1.0), 2: (0.5, 0.5)}.items() for t, p in enumerate(ps)], "doc_id long, topic int, p double")
    parents = spark.createDataFrame([(0, None), (1, 0), (2, 1)], "doc_id long, parent long")
    got = {(r["doc_id"], r["topic"]): r["p"] for r in smooth_on_tree(theta, parents, 0.4).collect()}
    assert np.isclose(got[0, 0], 1) and np.isclose(got[1, 0], 0.4) and np.isclose(got[2, 0], 0.6 * 0.5 + 0.4 * 0.4)
    m = M.CSATM(M.LDA(2, iters=6, seed=1), fall=0.5)
    w = {r["doc_id"]: r["weight"] for r in m.popularity(parents).collect()}
    assert w == {0: 1.75, 1: 1.5, 2: 1.0}
    docs = readers.from_tokens(spark, planted(2, 30))
    replies = spark.createDataFrame([(i, i - 2 if i > 1 else None) for i in range(30)], "doc_id long, parent long")
    simplex(m.fit(M.Corpus(docs), replies))
    simplex(M.ThreadTM(M.LDA(2, iters=6, seed=1)).fit(M.Corpus(docs), replies))


def test_deep_threads_cost_a_logarithm_of_rounds(spark):
    """A chain of 700 replies: weights and mixtures equal the plain recurrences; a cycle is an error."""
    n, share, fall = 700, 0.3, 0.9
    parents = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "doc_id long, parent long")
    w = {r["doc_id"]: r["weight"] for r in M.CSATM(M.LDA(2), fall=fall).popularity(parents).collect()}
    assert np.allclose([w[i] for i in range(n)], [(1 - fall ** (n - i)) / (1 - fall) for i in range(n)])
    p = np.random.default_rng(0).random(n)
    theta = spark.createDataFrame([(i, t, float(x)) for i, v in enumerate(p) for t, x in enumerate((v, 1 - v)) if i % 7], "doc_id long, topic int, p double")
    got = {r["doc_id"]: r["p"] for r in smooth_on_tree(theta, parents, share).where("topic = 0").collect()}
    v, m = 0.0, 0.0
    for i in range(n):
        keep = 1.0 if i == 0 else 1 - share
        v, m = keep * (p[i] if i % 7 else 0.0) + share * v, keep * (i % 7 > 0) + share * m
        assert (i not in got and m == 0) or np.isclose(got[i], v / m)
    loop = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, parent long")
    with pytest.raises(ValueError):
        M.CSATM(M.LDA(2), fall=0.5).popularity(loop)


def test_guided_nmf(spark):
    seeds = {"a": ["w00x", "w01x"], "b": ["w10x", "w11x"], "c": ["w20x", "w21x"]}
    fit = M.GuidedNMF(seeds, iters=20, seed=1).fit(M.Corpus(readers.from_tokens(spark, planted())))
    simplex(fit)
    assert len(blocks(fit.top_words())) == 3 and fit.theta.agg(F.min("doc_id")).first()[0] == 0


def test_supervised(spark):
    d = readers.from_tokens(spark, planted(2)).withColumn("y", F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(-1.0))
    m = M.SupervisedLDA(2, iters=8, seed=1)
    fit = m.fit(M.Corpus(d, carry=m.carry))
    err = m.predict(fit.theta).join(d, "doc_id").agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert err < 0.6


def test_hdp(spark):
    m = M.HDP(8, iters=15, seed=1)
    simplex(m.fit(M.Corpus(readers.from_tokens(spark, planted(3, 120)))))
    assert 2 <= len(m.used()) <= 8


def test_wordshoal(spark):
    rng = np.random.default_rng(2)
    true, docs, who, where = np.linspace(-1.5, 1.5, 10), [], [], []
    for dom in range(3):
        beta, psi = rng.standard_normal(30), rng.random(30) + 1
        for i, t in enumerate(true):
            docs.append([f"d{dom}v{j}" for j in range(30) for _ in range(rng.poisson(np.exp(psi[j] + beta[j] * t)))])
            who.append(f"s{i}")
            where.append(f"dom{dom}")
    m = M.Wordshoal(anchors=("s0", "s9")).fit(readers.from_tokens(spark, docs, speaker=who, domain=where), "speaker", "domain")
    assert abs(np.corrcoef(m.theta, true)[0, 1]) > 0.95


def test_topic_gpt(spark):
    def backend(prompt):
        return "Fruit" if "apple" in prompt.splitlines()[-1] else "Rivers"

    docs = spark.createDataFrame([(i, "apple pie" if i % 2 else "deep water") for i in range(6)] + [(6, None)], "doc_id long, text string")
    m = M.TopicGPT(backend, sample=6)
    assert sorted(m.propose(docs)) == ["Fruit", "Rivers"]
    assert {r["doc_id"]: r["topic"] for r in m.assign(docs).collect()} == {i: "Fruit" if i % 2 and i < 6 else "Rivers" for i in range(7)}


def test_signals(spark):
    rng = np.random.default_rng(3)
    s = rng.laplace(size=(600, 3))
    x = s @ rng.standard_normal((3, 5))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "doc_id long, embedding array<double>")
    m = M.SemanticSignals(3, seed=1).fit(v)
    got = np.zeros((600, 3))
    for r in m.doc_topic.collect():
        got[r["doc_id"], r["topic"]] = r["x"]
    c = np.abs(np.corrcoef(got.T, s.T)[:3, 3:])
    assert (c.max(axis=1) > 0.95).all() and sorted(c.argmax(axis=1)) == [0, 1, 2]
    wv = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0, 0.0])], "word string, embedding array<double>")
    assert m.words(wv, 1).count() == 3
