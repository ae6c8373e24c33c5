"""Structured, embedded, encoded and positional models on planted corpora."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill import models as M
from lexmill.models import base, neural, positions
from lexmill.sources import readers
from test_models import blocks, planted, simplex


def purity(model, of, k=3):
    """Share of documents whose leading topic is that of most documents of their kind."""
    rows = model.theta.groupBy("doc_id").agg(F.max_by("topic", "p").alias("t")).collect()
    table = np.zeros((k, model.num_topics))
    for r in rows:
        table[of(r["doc_id"]), r["t"]] += 1
    return table.max(axis=1).sum() / len(rows)


@pytest.fixture(scope="module")
def docs(spark):
    return readers.from_tokens(spark, planted()).persist()


def vectors(k=3, n=8):
    rng = np.random.default_rng(3)
    centres = np.eye(6)[:k] * 4
    return {f"w{b}{i}x": centres[b] + rng.normal(0, 0.2, 6) for b in range(k) for i in range(n)}


def test_dtm_words_drift(spark):
    """Topic 0 changes its words from w0-x to w3-x over four slices; topic 1 keeps its own."""
    rng = np.random.default_rng(0)
    texts, slices = [], []
    for t in range(4):
        for d in range(40):
            new = rng.random(14) < t / 3
            texts.append([f"w{(3 if new[i] else 0) if d % 2 else 1}{rng.integers(6)}x" for i in range(14)])
            slices.append(t)
    c = M.Corpus(readers.from_tokens(spark, texts, slice=slices), carry=("slice",))
    m = M.DTM(2, 4, chain_variance=0.3, iters=25, seed=2)
    simplex(m.fit(c))
    assert np.allclose(m.by_slice.sum(axis=2), 1)
    old, new = (np.array([w.startswith(x) for w in c.words]) for x in ("w0", "w3"))
    k = int(m.by_slice[:, 0, old].sum(axis=1).argmax())
    share = m.by_slice[k]
    assert share[0, old].sum() > 0.7 > 0.3 > share[0, new].sum() and share[3, new].sum() > 0.7
    assert m.drift()[k] > 2 * m.drift()[1 - k]


def test_dtm_leaves_out_other_slices(spark):
    d = readers.from_tokens(spark, planted(2, 20), slice=[i % 2 if i < 18 else 7 for i in range(20)])
    m = M.DTM(2, 2, iters=4).fit(M.Corpus(d, carry=("slice",)))
    assert m.theta.select("doc_id").distinct().count() == 18


def test_sage_groups_word_topics_their_own_way(spark):
    rng = np.random.default_rng(1)
    texts = [[f"w{d % 2}{rng.integers(6)}x" if rng.random() < 0.7 else f"{'north' if d % 4 < 2 else 'south'}{'abc'[rng.integers(3)]}" for _ in range(16)] for d in range(120)]
    c = M.Corpus(readers.from_tokens(spark, texts, grp=[0 if d % 4 < 2 else 1 for d in range(120)]), carry=("grp",))
    m = M.SAGE(2, 2, iters=20, seed=1)
    simplex(m.fit(c))
    north = np.array([w.startswith("north") for w in c.words])
    assert (m.by_group[:, 0, north].sum(axis=1) > 0.1).all() and (m.by_group[:, 1, north].sum(axis=1) < 0.05).all()
    assert (m.both == 0).mean() > 0.3  # sparse


def test_pachinko(docs):
    m = M.PA(2, 3, iters=40, seed=0)
    fitted = m.fit(M.Corpus(docs))
    simplex(fitted)
    assert len(blocks(fitted.top_words())) == 3 and np.allclose(m.super_sub.sum(axis=1), 1)


def test_hierarchy_shares_its_root(spark):
    rng = np.random.default_rng(0)
    texts = [[f"all{'abcd'[rng.integers(4)]}" if rng.random() < 0.4 else f"w{d % 2}{rng.integers(6)}x" for _ in range(20)] for d in range(120)]
    m = M.HLDA(depth=2, branching=2, iters=30, seed=1)
    fitted = m.fit(M.Corpus(readers.from_tokens(spark, texts)))
    simplex(fitted)
    top = fitted.top_words(4)
    assert all(w.startswith("all") for w in top[0])
    assert {top[1][0][:2], top[2][0][:2]} == {"w0", "w1"}


def test_pseudo_documents(spark):
    texts = planted(3, 150, 4, seed=2)
    m = M.PT(3, pseudo=12, iters=40, seed=3)
    fitted = m.fit(M.Corpus(readers.from_tokens(spark, texts)))
    simplex(fitted)
    assert purity(fitted, lambda d: d % 3) > 0.9


def test_links_tie_documents(spark, docs):
    pairs = [(i, i + 3) for i in range(87)]
    m = M.RTM(3, iters=12, seed=1)
    fitted = m.fit(M.Corpus(docs), spark.createDataFrame(pairs, "src long, dst long"))
    simplex(fitted)
    chance = {(r["src"], r["dst"]): r["chance"] for r in m.strength(spark.createDataFrame([(0, 3), (0, 4)], "src long, dst long"), fitted.theta).collect()}
    assert chance[0, 3] > chance[0, 4]


def test_corex_with_anchor(docs):
    m = M.CorEx(3, anchors=[["w20x"]], iters=30, seed=0).fit(M.Corpus(docs))
    top = m.top_words(4)
    assert all(w.startswith("w2") for w in top[0])
    p = m.doc_topic.where("topic = 0").groupBy(F.col("doc_id") % 3).agg(F.avg("p")).collect()
    p = dict(map(tuple, p))
    assert p[2] > 0.9 and p[0] < 0.1 and p[1] < 0.1


def test_factorial_tuples(docs):
    m = M.FactorialLDA((3, 2), iters=12, seed=0)
    fitted = m.fit(M.Corpus(docs))
    simplex(fitted)
    assert fitted.num_topics == 6 and m.values(fitted.topic_word, 0).shape == (3, 24)


def test_narrative_curve(spark):
    texts = [[f"w0{i % 6}x" for i in range(40)] + [f"w1{i % 6}x" for i in range(40)] for _ in range(30)]
    m = M.NarrativeTM(2, degree=2, chunk=20, iters=25, seed=1)
    chunks = m.chunks(readers.from_tokens(spark, texts))
    assert chunks.count() == 120
    fitted = m.fit(M.Corpus(chunks, carry=("features",)))
    early = int(np.array([w.startswith("w0") for w in fitted.words]) @ fitted.topic_word.T @ np.array([0, 1]) > 0.5)
    t = m.trajectory(3)
    assert t[0, early] > 0.8 and t[2, early] < 0.2


def test_embedded_topics(docs):
    m = M.ETM(3, vectors(), iters=20)
    fitted = m.fit(M.Corpus(docs))
    simplex(fitted)
    assert len(blocks(fitted.top_words())) == 3


def test_embedded_topics_over_time(spark):
    d = readers.from_tokens(spark, planted(), slice=[i // 45 for i in range(90)])
    m = M.DETM(3, 2, vectors(), iters=12)
    fitted = m.fit(M.Corpus(d, carry=("slice",)))
    simplex(fitted)
    assert len(blocks(fitted.top_words())) == 3 and m.by_slice.shape[:2] == (3, 2)


def test_gaussian_topics(docs):
    m = M.GaussianLDA(3, vectors(), iters=15)
    fitted = m.fit(M.Corpus(docs))
    simplex(fitted)
    assert len(blocks(fitted.top_words())) == 3 and m.means.shape == (3, 6)


def test_prodlda(spark):
    fitted = M.ProdLDA(3, hidden=20, rounds=40, lr=0.02, batch=30, seed=1).fit(M.Corpus(readers.from_tokens(spark, planted(3, 240))))
    simplex(fitted)
    assert purity(fitted, lambda d: d % 3) > 0.9


def test_combined_and_zero_shot(spark):
    texts = planted(3, 240)
    c = M.Corpus(readers.from_tokens(spark, texts))
    rng = np.random.default_rng(5)
    e = spark.createDataFrame([(i, (np.eye(4)[i % 3] + rng.normal(0, 0.05, 4)).tolist()) for i in range(240)], "doc_id long, embedding array<double>")
    for kind in (M.CombinedTM, M.ZeroShotTM):
        fitted = kind(3, hidden=20, rounds=40, lr=0.02, batch=30, seed=1).fit(c, e)
        simplex(fitted)
        assert purity(fitted, lambda d: d % 3) > 0.9


def test_scholar_predicts_classes(spark):
    d = readers.from_tokens(spark, planted(3, 240), y=[i % 3 for i in range(240)], features=[[float(i % 3 == 0)] for i in range(240)])
    m = M.Scholar(3, hidden=20, rounds=40, lr=0.02, batch=30, seed=1, n_features=1, n_classes=3)
    fitted = m.fit(M.Corpus(d, carry=m.carry))
    right = [r["y"] == r["doc_id"] % 3 for r in m.classes(fitted.theta).collect()]
    assert np.mean(right) > 0.9


def test_tbip_orders_authors(spark):
    """Six authors from one end to the other: the share of left words falls along them in both topics."""
    rng = np.random.default_rng(0)
    texts, who = [], []
    for a in range(6):
        for d in range(30):
            left = rng.random(30) > a / 5
            texts.append([f"t{d % 2}{'left' if left[i] else 'right'}{'abc'[rng.integers(3)]}" if rng.random() < 0.5 else f"t{d % 2}mid{'abc'[rng.integers(3)]}" for i in range(30)])
            who.append(f"author{a}")
    m = M.TBIP(2, iters=40, seed=0)
    fitted = m.fit(M.Corpus(readers.from_tokens(spark, texts, author=who), carry=("author",)), start={"author0": -1.0, "author5": 1.0})
    simplex(fitted)
    x = [m.ideal_points[f"author{a}"] for a in range(6)]
    assert abs(np.corrcoef(x, range(6))[0, 1]) > 0.95


def test_ideal_points_of_vectors(spark):
    rng = np.random.default_rng(0)
    way = np.array([[0, 0, 1.0, 0], [0, 0, 0, 1.0]])
    rows = []
    for i in range(400):
        a, k = i % 8, (i // 8) % 2
        rows.append((i, f"a{a}", (np.eye(4)[k] * 5 + way[k] * (a - 3.5) / 2 + rng.normal(0, 0.1, 4)).tolist()))
    e = spark.createDataFrame(rows, "doc_id long, author string, embedding array<double>")
    start = spark.createDataFrame([(0, [5.0, 0.0, 0.0, 0.0]), (1, [0.0, 5.0, 0.0, 0.0])], "topic int, embedding array<double>")
    m = M.IdealPointSentenceTM(2, iters=40).fit(e, start)
    x = [m.positions()[f"a{a}"] for a in range(8)]
    assert abs(np.corrcoef(x, range(8))[0, 1]) > 0.98
    assert m.doc_topic.where("p > 0.9").count() == 400


def test_tensor_lda_in_one_go_and_in_batches(spark):
    rng = np.random.default_rng(0)
    texts = []
    for _ in range(400):
        theta = rng.dirichlet(np.full(3, 0.3))
        texts.append([f"w{rng.choice(3, p=theta)}{rng.integers(5)}x" for _ in range(20)])
    c = M.Corpus(readers.from_tokens(spark, texts))
    fitted = M.TensorLDA(3, alpha_0=0.9).fit(c)
    simplex(fitted)
    assert len(blocks(fitted.top_words())) == 3
    m = M.TensorLDA(3, alpha_0=0.9)
    m._whiten(c)
    rows = c.rows
    for part in (0, 1):
        c.rows = rows.where(F.col("doc_id") % 2 == part)
        m.partial_fit(c)
    assert np.allclose(np.sort(m.finalize(), axis=0), np.sort(fitted.topic_word, axis=0), atol=1e-6)


def test_collapsed_updates(docs):
    m = M.LDA(3, iters=40, seed=1, inference="cvb0").fit(M.Corpus(docs))
    simplex(m)
    assert len(blocks(m.top_words())) == 3
    with pytest.raises(ValueError):
        M.LDA(3, inference="other")


def test_tree_field_ties_replies_to_parents(spark, docs):
    parents = spark.createDataFrame([(i, i - 3 if i >= 3 else None) for i in range(90)], "doc_id long, parent long")
    m = M.TreeFieldTM(3, blend=0.5, rounds=2, iters=10, seed=1)
    fitted = m.fit(M.Corpus(docs), parents)
    simplex(fitted)
    assert len(blocks(fitted.top_words())) == 3 and purity(fitted, lambda d: d % 3) > 0.95


def test_windows_have_topics_of_their_own(spark):
    """Every text has words of its own kind (global) and passes through three aspects in turn (local)."""
    rng = np.random.default_rng(0)
    texts = []
    for d in range(60):
        sentences = []
        for s in range(9):
            words = [f"w{d % 2}{'abc'[rng.integers(3)]}x" for _ in range(3)] + [f"asp{s // 3}{'abc'[rng.integers(3)]}x".replace("0", "zero").replace("1", "one").replace("2", "two") for _ in range(4)]
            sentences.append(" ".join(words).replace("w0", "left").replace("w1", "right") + ".")
        texts.append(" ".join(sentences))
    df = readers.from_texts(spark, texts)
    from lexmill.operators import vocabulary as V
    m = M.MGLDA(2, 3, alpha_local=0.01, iters=40, seed=1)
    fitted = m.fit(df, M.Corpus(V.corpus(df)))
    simplex(fitted)
    top = fitted.top_words(3)
    assert {w[:4] for w in top[0] + top[1]} == {"left", "righ"}
    assert len({w[:6] for ws in top[2:] for w in ws if w.startswith("asp")}) == 3


def test_smooth_sums_take_some_words_at_a_time():
    """Sums over words at all points of the grid never hold words times points."""
    import tracemalloc

    rng = np.random.default_rng(0)
    x, w, at = rng.normal(0, 0.3, 100_000), rng.random((2, 100_000)), rng.normal(size=30)
    tracemalloc.start()
    got = positions._on_grid(x, w, at, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # words times points take 103 MB
    assert np.allclose(got, [[(v * x * np.exp(a * x)).sum() for a in at] for v in w], rtol=1e-3)


def test_windows_of_sentences_equal_those_of_words():
    """Fitting windows by sentence gives what fitting them by word and window does."""
    rng, v, t, kg, kl = np.random.default_rng(8), 12, 3, 2, 3
    m = M.MGLDA(kg, kl, window=t)
    rows = []
    for many in (5, 1, 3):
        e = sorted((int(s), int(i)) for s in rng.choice(many + 1, many, replace=False) for i in rng.choice(v, 4, replace=False))
        rows.append(([s for s, _ in e], [i for _, i in e], rng.integers(1, 4, len(e)).tolist()))
    bag = base.Bags(pa.RecordBatch.from_pydict({c: [r[j] for r in rows] for j, c in enumerate("sin")}))
    phi = rng.dirichlet(np.ones(v), kg + kl).T
    got, like = m._windows(bag, phi)
    for d, (s, i, n) in enumerate(rows):
        b, n, last = phi[i], np.array(n, float), max(s) + t
        whole, local, share, place = np.full(kg, 1 / kg), np.full((last, kl), 1 / kl), np.full(last, 0.5), np.full((last, t), 1 / t)
        for _ in range(15):
            g, w = np.zeros((len(s), t, kg)), np.zeros((len(s), t, kl))
            for e in range(len(s)):
                for j in range(t):
                    g[e, j] = whole * b[e, :kg] * place[s[e], j] * share[s[e] + j]
                    w[e, j] = local[s[e] + j] * b[e, kg:] * place[s[e], j] * (1 - share[s[e] + j])
            p = g.sum(axis=(1, 2)) + w.sum(axis=(1, 2))
            g, w = g * (n / p)[:, None, None], w * (n / p)[:, None, None]
            whole, local, place, ng, nl = g.sum(axis=(0, 1)) + m.alpha[:kg], np.full((last, kl), 0.1), np.full((last, t), 0.1), np.zeros(last), np.zeros(last)
            for e in range(len(s)):
                for j in range(t):
                    local[s[e] + j] += w[e, j]
                    ng[s[e] + j] += g[e, j].sum()
                    nl[s[e] + j] += w[e, j].sum()
                    place[s[e], j] += g[e, j].sum() + w[e, j].sum()
            whole, local, place = whole / whole.sum(), local / local.sum(axis=1, keepdims=True), place / place.sum(axis=1, keepdims=True)
            share = (ng + 0.1) / (ng + nl + 0.2)
        assert np.isclose(like[d], (n * np.log(p)).sum()) and np.allclose(got[bag.own == d], np.concatenate((g.sum(axis=1), w.sum(axis=1)), axis=1))


def test_decoder_takes_words_in_blocks(monkeypatch):
    """The decoder's bound and slopes are the same whether its words are taken together or a few at a time, and those of differences."""
    rng, v = np.random.default_rng(9), 23
    rows = [sorted(rng.choice(v, 6, replace=False).tolist()) for _ in range(7)]
    bag = base.Bags(pa.RecordBatch.from_pydict({"i": rows, "n": [rng.integers(1, 4, 6).tolist() for _ in rows]}))
    m = M.ProdLDA(3, hidden=4)
    p = m._start(m._shapes(v, 0))
    theta = rng.dirichlet(np.ones(3), 7)

    def decoded(words, beta):
        monkeypatch.setattr(neural, "WORDS", words)
        slopes, q = np.zeros((3, v)), p | {"beta": beta.copy(), "out": p["out"].copy()}
        bound, dtheta = m._decoded(bag, q, theta, lambda at, x: slopes.__setitem__((slice(None), at), x))
        return bound, dtheta, slopes, q["out"]

    one, few = decoded(100, p["beta"]), decoded(5, p["beta"])
    assert all(np.allclose(x, y, rtol=1e-4, atol=1e-4) for x, y in zip(one, few, strict=True))
    for k, w in ((0, 3), (2, 17)):
        step = np.zeros((3, v))
        step[k, w] = 0.05
        slope = (decoded(5, p["beta"] + step)[0] - decoded(5, p["beta"] - step)[0]) / 0.1
        assert np.isclose(-slope / 7, few[2][k, w], rtol=0.02, atol=0.01)
