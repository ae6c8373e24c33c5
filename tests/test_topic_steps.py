"""Topics, mixtures and ranks at size: what is read, multiplied or held in one task."""

import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexmill.functions.arrays import digamma
from lexmill.models.base import Bags
from lexmill.models.variational import INNER, TOL, e_steps, short
from lexmill import models as M
from lexmill.operators import cooccurrence, embedding, topics, weights
from lexmill.plans import base


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_tokens_are_read_once_for_topics(spark):
    rows = [(k, w) for k, text in (("a", "x x y"), ("b", "y z"), ("c", "z z z w")) for w in text.split()]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    phi = topics.phi_from(spark.createDataFrame(rows, "topic string, word string").mapInArrow(counted, "topic string, word string"), 0.5)
    got = {(r["topic"], r["word"]): r["p"] for r in phi.collect()}
    n, total = Counter(rows), Counter(k for k, _ in rows)
    assert got == {(k, w): pytest.approx((n[k, w] + 0.5) / (total[k] + 0.5 * 4)) for k in "abc" for w in "xyzw"}
    assert seen.value == len(rows)


def midranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_ranks_hold_no_topic_in_one_window(spark):
    p = np.random.default_rng(0).integers(1, 6, (3, 40)) / 100.0
    phi = spark.createDataFrame([(k, f"w{i:02}", float(p[k, i])) for k in range(3) for i in range(40)], "topic int, word string, p double")
    e = np.round(p / p.sum(axis=0), 12)
    f, x = (np.array([midranks(r) / 40 for r in m]) for m in (p, e))
    frex = topics.frex(phi)
    assert {(r["topic"], r["word"]): r["score"] for r in frex.collect()} == {(k, f"w{i:02}"): pytest.approx(1 / (0.5 / f[k, i] + 0.5 / x[k, i])) for k in range(3) for i in range(40)}
    excl = topics.exclusivity(phi, 5)
    top = [sorted(range(40), key=lambda i: (-p[k, i], i))[:5] for k in range(3)]
    assert {r["topic"]: r["score"] for r in excl.collect()} == {k: pytest.approx(sum(1 / (0.7 / x[k, i] + 0.3 / f[k, i]) for i in top[k])) for k in range(3)}
    assert not re.search(r"\brank\(", plan(frex) + plan(excl))


def test_mixtures_send_only_shared_words(spark):
    docs = spark.createDataFrame([(1, "en", ["a", "both", "a"]), (2, "de", ["b", "both"]), (3, "en", ["both"]), (4, None, ["b", "new", "both"]), (4, "de", ["b"])], "doc_id long, lang string, tokens array<string>")
    theta = base.theta(docs)
    got = {(r["doc_id"], r["topic"]): round(r["p"], 9) for r in theta.collect()}
    counts = {1: (3, 0), 2: (1, 1), 3: (1, 0), 4: (1, 2)}  # both leads to en; new has no language
    assert got == {(d, t): round((n + 0.1) / (sum(c) + 0.2), 9) for d, c in counts.items() for t, n in zip(("en", "de"), c, strict=True)}
    assert re.search(r"BroadcastHashJoin \[word#\d+\], \[word#\d+\], LeftOuter", plan(theta))


def test_outliers_multiply_no_word_by_topics(spark):
    words = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (2, "z", 1), (3, "none", 1)], "doc_id long, word string, n long")
    phi = spark.createDataFrame([("a", "x", 0.5), ("b", "x", 0.5), ("b", "y", 0.1), ("a", "z", 0.2), ("b", "z", 0.2)], "topic string, word string, p double")
    out = embedding.assign_outliers(words, phi)
    assert {tuple(r) for r in out.collect()} == {(1, "a"), (2, "a")}  # a lacks y, which then doesn't count for it
    assert not re.search(r"keys=\[doc_id#\d+L?, topic#", plan(out))


def test_windows_of_pairs_take_time_linear_in_a_row(spark):
    """Squares of 20,000 runs took minutes."""
    n, w = 20_000, 3
    tokens = ["x", "y", "o", "o", "o", "o", "o"] * n
    docs = spark.createDataFrame([(1, tokens), (2, ["x", "o", "y", "y", "x"])], "doc_id long, tokens array<string>")
    top = spark.createDataFrame([("t", 1, "x"), ("t", 2, "y")], "topic string, rank int, word string")
    starts = [{"x", "y"} <= set(t[s : s + w]) for t in (tokens, ["x", "o", "y", "y", "x"]) for s in range(len(t) - w + 1)]
    began = time.time()
    _, _, co = cooccurrence.window_counts(docs, top, w)
    assert [tuple(r) for r in co.collect()] == [("x", "y", sum(starts))]
    assert time.time() - began < 20


def test_inference_runs_along_memory():
    """Equal to plain loops over documents, and faster than sums over rows of K."""
    rng, k, v = np.random.default_rng(0), 20, 5000
    docs = [np.unique(rng.integers(0, v, rng.integers(1, 200)), return_counts=True) for _ in range(1000)]
    lists = [pa.array([x[j].astype(np.int32) for x in docs], pa.list_(pa.int32())) for j in (0, 1)]
    bag = Bags(pa.RecordBatch.from_arrays(lists, ["i", "n"]))
    beta, alpha = short(rng.dirichlet(np.full(v, 0.1), k)), np.full(k, 0.1)
    e_steps(bag, alpha, beta)
    began = time.time()
    gamma, stats, like = e_steps(bag, alpha, beta)
    took = time.time() - began
    for d in (0, 17, 999):
        i, n = docs[d]
        g = alpha + n.sum() / k
        for _ in range(INNER):
            et = np.exp(digamma(g) - digamma(np.array([g.sum()])))
            g, old = alpha + et * ((n / (beta[i] @ et))[:, None] * beta[i]).sum(axis=0), g
            if np.abs(g - old).mean() <= TOL * n.sum() / k + 1e-5:
                break
        et = np.exp(digamma(g) - digamma(np.array([g.sum()])))
        assert np.allclose(gamma[d], g, rtol=0.02, atol=0.02) and np.isclose(like[d], n @ np.log(beta[i] @ et), rtol=1e-4)  # it may take a few rounds more
        assert np.allclose(stats[bag.own == d].sum(axis=1), n, rtol=1e-4)
    b, rounds = beta[bag.i], 20
    began = time.time()
    for _ in range(rounds):  # rounds by rows
        et = np.exp(digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True))).astype(np.float32)
        norm = np.einsum("ij,ij->i", et[bag.own], b).astype(np.float64) + 1e-100
        np.add.reduceat(b * (bag.n / norm).astype(np.float32)[:, None], bag.first, axis=0, dtype=np.float64)
    assert took < (time.time() - began) / rounds * INNER * 0.6


def shuffled(spark) -> int:
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_encoders_send_words_that_tasks_met(spark):
    docs = spark.createDataFrame([(d, [f"w{d * 10 + j}" for j in range(10)]) for d in range(400)], "doc_id long, tokens array<string>")
    c = M.Corpus(docs)
    assert c.rows.count() == 400 and c.size == 4000
    before = shuffled(spark)
    m = M.ProdLDA(2, hidden=64, rounds=1).fit(c)
    assert len(m.fit_history) == 1
    assert shuffled(spark) - before < 4_000_000  # three times the network from each of four tasks is 13 MB


def test_tfidf_shuffles_rare_words_only(spark, monkeypatch):
    rows = [(1, ["a", "a", "b", "x"]), (2, ["a", "b", "y"]), (3, ["a", "c"]), (3, ["c", "z"]), (None, ["a", "n", "x"])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    bags = {}
    for d, t in rows:
        bags.setdefault(d, Counter()).update(t)
    df = Counter(w for b in bags.values() for w in b)
    want = {}
    for d, b in bags.items():
        x = {w: n * (np.log(6 / (1 + df[w])) + 1) for w, n in b.items()}
        want |= {(d, w): pytest.approx(v / np.sqrt(sum(y * y for y in x.values()))) for w, v in x.items()}
    for sent in (250_000, 2, 0):
        monkeypatch.setattr(weights, "SENT", sent)
        out = weights.tfidf(docs)
        assert {(r["doc_id"], r["word"]): r["weight"] for r in out.collect()} == want
    monkeypatch.setattr(weights, "SENT", 250_000)
    assert not re.search(r"hashpartitioning\(word", plan(weights.tfidf(docs)))


def test_bootstrap_makes_no_row_a_replicate(spark):
    texts = [["p", "q"], ["p"], ["q", "r"], ["p", "q", "r"], ["s"]] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, tokens array<string>")
    top = spark.createDataFrame([(0, 1, "p"), (0, 2, "q"), (0, 3, "r"), (1, 1, "q"), (1, 2, "s")], "topic int, rank int, word string")
    drawn = docs.selectExpr("doc_id", "explode(sequence(1, 30)) as rep").selectExpr("doc_id", "rep", "pmod(xxhash64(5, rep, doc_id), 1073741824) / 1073741824D as u").collect()
    marks = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040]))
    w = {(r["rep"], r["doc_id"]): int((r["u"] >= marks).sum()) for r in drawn}
    score = {0: [], 1: []}
    for rep in range(1, 31):
        n = lambda *ws: sum(w[rep, d] for d, t in enumerate(texts) if set(ws) <= set(t))  # noqa: B023, E731
        for k, pairs in ((0, [("p", "q"), ("p", "r"), ("q", "r")]), (1, [("q", "s")])):
            score[k].append(sum(np.log((n(a, b) + 1) / n(a)) for a, b in pairs))
    got = cooccurrence.coherence_bootstrap(docs, top, 30, 5)
    rows = {r["topic"]: r for r in got.collect()}
    for k, x in score.items():
        assert rows[k]["mean"] == pytest.approx(np.mean(x)) and rows[k]["sd"] == pytest.approx(np.std(x, ddof=1))
    assert "Generate explode(sequence" not in plan(got)
