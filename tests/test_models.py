"""Estimators on planted corpora: simplex tables, recovery of blocks, saving and loading."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill import models as M
from lexmill.models import base, mixture, variational
from lexmill.operators import documents
from lexmill.sources import readers


def planted(k=3, n=90, length=14, seed=0):
    rng = np.random.default_rng(seed)
    return [[f"w{b}{rng.integers(8)}x" for _ in range(length)] for b in (i % k for i in range(n))]


@pytest.fixture(scope="module")
def docs(spark):
    return readers.from_tokens(spark, planted()).persist()


def blocks(top):
    """Distinct blocks that topics' leading words lie in, each topic within one."""
    found = [{w[:2] for w in ws[:5]} for ws in top]
    assert all(len(f) == 1 for f in found), top
    return {next(iter(f)) for f in found}


def simplex(model):
    assert np.allclose(model.topic_word.sum(axis=1), 1)
    off = model.theta.groupBy("doc_id").agg(F.abs(F.sum("p") - 1).alias("d")).agg(F.max("d")).first()[0]
    assert off < 1e-6


def test_lda(spark, docs, tmp_path):
    m = M.LDA(3, iters=25, seed=1).fit(M.Corpus(docs))
    simplex(m)
    assert len(blocks(m.top_words())) == 3
    m.save(spark, str(tmp_path / "m"))
    again = M.TopicModel.load(spark, str(tmp_path / "m"))
    assert np.allclose(again.topic_word, m.topic_word) and again.theta.count() == m.theta.count()
    assert m.coherence(docs).count() == 3


def test_online(docs):
    m = M.OnlineLDA(3, iters=16, batches=2, tau=1.0, seed=1)
    simplex(m.fit(M.Corpus(docs)))
    assert m.t == 16


def test_seeded(docs):
    m = M.SeededLDA({"a": ["w00x", "w01x"], "b": ["w10x", "w11x"], "c": ["w20x"]}, iters=10).fit(M.Corpus(docs))
    assert [ws[0][:2] for ws in m.top_words()] == ["w0", "w1", "w2"]


def test_labeled(spark):
    d = readers.from_tokens(spark, planted()).withColumn("labels", F.array(F.concat(F.lit("l"), (F.col("doc_id") % 3).cast("string"))))
    m = M.LabeledLDA(["l0", "l1", "l2"], iters=5).fit(M.Corpus(d, carry=("labels",)))
    simplex(m)
    assert [ws[0][:2] for ws in m.top_words()] == ["w0", "w1", "w2"]
    best = m.theta.where("p > 0.9").select("doc_id", "topic").collect()
    assert all(r["topic"] == r["doc_id"] % 3 for r in best) and len(best) == 90


def test_dmr(spark):
    d = readers.from_tokens(spark, planted(2)).withColumn("features", F.array((F.col("doc_id") % 2).cast("double")))
    model = M.DMR(2, 1, iters=12, seed=3)
    simplex(model.fit(M.Corpus(d, carry=("features",))))
    assert np.abs(model.coef[:, 1]).max() > 0.5


def test_polylingual(spark):
    d = [[f"{lang}:{w}" for lang in ("en", "fr") for w in ws] for ws in planted(2, 40)]
    m = M.PolylingualLDA(2, iters=8, seed=2).fit(M.Corpus(readers.from_tokens(spark, d)))
    en = [i for i, w in enumerate(m.words) if w.startswith("en:")]
    assert np.allclose(m.topic_word[:, en].sum(axis=1), 1)


def test_gsdmm(spark, docs):
    m = M.GSDMM(6, iters=12, seed=1).fit(M.Corpus(docs))
    by = m.theta.join(docs.select("doc_id", (F.col("doc_id") % 3).alias("b")), "doc_id").groupBy("topic").agg(F.countDistinct("b").alias("n"))
    assert by.agg(F.max("n")).first()[0] == 1


def test_btm(docs):
    m = M.BTM(3, iters=40, seed=4).fit(docs, M.Corpus(docs))
    simplex(m)
    assert len(blocks(m.top_words())) >= 2


def test_nmf(docs):
    m = M.NMF(3, iters=25, seed=1).fit(M.Corpus(docs))
    simplex(m)
    assert len(blocks(m.top_words())) == 3
    errors = [e for _, e in m.fit_history]
    assert errors[-1] <= errors[0]


def test_lsa_matches_svd(docs):
    c = M.Corpus(docs)
    m = M.LSA(3, weighting="counts").fit(c)
    x = np.zeros((90, c.size))
    for r in c.rows.collect():
        x[r["doc_id"], r["i"]] = r["n"]
    assert np.allclose(m.singular_values, np.linalg.svd(x, compute_uv=False)[:3], rtol=1e-3)
    assert m.doc_topic.count() == 270


def test_keynmf_and_clusters(spark):
    rng = np.random.default_rng(0)
    docs = readers.from_tokens(spark, planted())
    centre = np.eye(3, 6)
    dv = spark.createDataFrame([(i, [float(x) for x in centre[i % 3] + 0.05 * rng.standard_normal(6)]) for i in range(90)], "doc_id long, embedding array<double>")
    wv = spark.createDataFrame([(f"w{b}{j}x", [float(x) for x in centre[b] + 0.05 * rng.standard_normal(6)]) for b in range(3) for j in range(8)], "word string, embedding array<double>")
    words = docs.select("doc_id", F.explode("tokens").alias("word"))
    m = M.KeyNMF(3, iters=15, seed=1).fit_embeddings(words, dv, wv)
    assert len(blocks(m.top_words())) == 3
    b = M.BERTopic(3, seed=1).fit(docs, dv)
    rows = b.info().collect()
    assert len(rows) == 3 and {r["words"][0][:2] for r in rows} == {"w0", "w1", "w2"}
    t = M.Top2Vec(3, top_n=3, seed=1).fit(docs, dv)
    assert t.nearest_words(wv).groupBy("topic").agg(F.countDistinct(F.substring("word", 1, 2)).alias("n")).agg(F.max("n")).first()[0] == 1


def test_wordfish(spark):
    rng = np.random.default_rng(1)
    true = np.linspace(-1.5, 1.5, 12)
    beta, psi = rng.standard_normal(40), rng.random(40) + 1
    docs = [[f"v{j}" for j in range(40) for _ in range(rng.poisson(np.exp(psi[j] + beta[j] * t)))] for t in true]
    d = readers.from_tokens(spark, docs, author=[f"a{i:02d}" for i in range(12)])
    m = M.Wordfish(anchors=("a00", "a11")).fit(d, "author")
    assert np.corrcoef(m.theta, true)[0, 1] > 0.97
    assert m.positions(spark).count() == 12


def test_ctm_and_stm(spark, docs):
    m = M.CTM(3, iters=8, seed=1)
    fit = m.fit(M.Corpus(docs))
    simplex(fit)
    assert len(blocks(fit.top_words())) == 3
    d = readers.from_tokens(spark, planted(2)).withColumn("features", F.array((F.col("doc_id") % 2).cast("double"))).withColumn("group", F.when(F.col("doc_id") < 45, "old").otherwise("new"))
    s = M.STM(2, n_features=1, iters=8, seed=1, groups=["old", "new"])
    fit = s.fit(M.Corpus(d, carry=s.carry))
    simplex(fit)
    assert abs(s.coef[1, 0]) > 1 and set(s.group_words) == {"old", "new"}
    like = [x for _, x in fit.fit_history]
    assert like[-1] >= like[0]
    draws = s.draws(3)
    assert draws.count() == 3 * 90 * 2 and abs(draws.agg(F.sum("p")).first()[0] - 270) < 1e-6


def test_keyatm(docs):
    m = M.KeyATM({"a": ["w00x", "w03x"], "b": ["w10x"], "c": ["w20x", "w21x"]}, iters=15, seed=1)
    fit = m.fit(M.Corpus(docs))
    simplex(fit)
    assert [{w[:2] for w in ws[:5]} for ws in fit.top_words()] == [{"w0"}, {"w1"}, {"w2"}] and (m.pi > 0).all()


def test_topics_over_time(spark):
    d = readers.from_tokens(spark, planted(2)).withColumn("time", F.when(F.col("doc_id") % 2 == 0, 0.2).otherwise(0.8) + F.col("doc_id") / 1000.0)
    m = M.TopicsOverTime(2, iters=10, seed=1)
    fit = m.fit(M.Corpus(d, carry=("time",)))
    simplex(fit)
    peaks = sorted(m.shape[:, 0] / m.shape.sum(axis=1))
    assert peaks[0] < 0.4 < 0.6 < peaks[1]


def test_author_topic(spark):
    d = readers.from_tokens(spark, planted(2)).withColumn("authors", F.array(F.concat(F.lit("a"), (F.col("doc_id") % 4).cast("string"))))
    m = M.AuthorTopic(2, iters=40, seed=1)
    simplex(m.fit(M.Corpus(d, carry=("authors",))))
    best = m.author_topic.argmax(axis=1).tolist()
    assert best[0] == best[2] != best[1] == best[3]


def test_anchors(docs):
    fit = M.AnchorLDA(3).fit(docs)
    simplex(fit)
    assert len(blocks(fit.top_words())) == 3


def test_registered_fits_use_the_default_vocabularies(spark, tmp_path, monkeypatch):
    from lexmill import models
    from lexmill.plans import model_queries as Q

    texts = [" ".join("ab"[k % 2] + "".join(chr(97 + j // 26**e % 26) for e in range(3)) for j in range(2000)) for k in range(12)]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert Q._corpus(spark, str(tmp_path)).size == 4000
    seen = []
    for cls in (models.AnchorLDA, models.Wordfish):
        monkeypatch.setattr(cls, "fit", lambda self, *args: seen.append(vars(self)) or (_ for _ in ()).throw(InterruptedError))
    for query in (Q.anchor_lda_fit, Q.wordfish_positions):
        with pytest.raises(InterruptedError):
            query(spark, str(tmp_path))
    assert (seen[0]["width"], seen[1]["max_words"], seen[1]["iters"]) == (256, 20_000, 100)


def test_sums_of_matrices_leave_columns_of_zeros_out(spark):
    """Sparse and full blocks, both widths of cells, the vector, and empty tasks."""
    from lexmill.models.base import CELLS, parts, summed

    for v in (7, CELLS):
        def run(batches, v=v):
            total, extra = np.zeros((3, v)), np.zeros(2)
            for b in batches:
                for i in b.column(0).to_pylist():
                    total[:, i * 997 % v] += [1.0, i, 0.5]
                    total[2, v - 1] += 1.0
                    extra += [i, 1.0]
            yield from parts(total, extra)

        got, extra = summed(spark.range(0, 200, 1, 9), run, (3, v), 2)
        want = np.zeros((3, v))
        for i in range(200):
            want[:, i * 997 % v] += [1.0, i, 0.5]
            want[2, v - 1] += 1.0
        assert np.allclose(got, want) and extra.tolist() == [19900.0, 200.0]
    sent = sum(len(b.column(2)[0].as_buffer()) for b in parts(np.eye(3, CELLS)))
    assert sent == 3 * 3 * 4  # three columns of three cells, four bytes each


def test_every_word_that_pruning_leaves_is_fitted(spark):
    """More words than the 200,000 at which vocabularies were once cut."""
    docs = spark.range(41).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda i: F.concat(F.lit("w"), (F.col("id") * 5000 + i).cast("string"))).alias("tokens"))
    assert M.Corpus(docs).size == 205_000


def test_documents_settle_in_fewer_rounds(monkeypatch):
    """Started beyond the last round's result, documents come nearer to where they settle, in fewer rounds."""
    rng, k, v = np.random.default_rng(5), 8, 200
    rows = [np.sort(rng.choice(v, 40, replace=False)) for _ in range(50)]
    batch = pa.RecordBatch.from_pydict({"i": [r.tolist() for r in rows], "n": [rng.integers(1, 4, 40).tolist() for _ in rows]})
    bag, beta, alpha = next(base.bags([batch], k)), variational.short(rng.gamma(0.3, 1.0, (k, v))), np.full(k, 1 / k)

    def fitted(beyond, tol, inner):
        calls, plain = [], np.einsum
        with monkeypatch.context() as m:
            for name, x in (("BEYOND", beyond), ("TOL", tol), ("INNER", inner)):
                m.setattr(variational, name, x)
            m.setattr(np, "einsum", lambda *a: calls.append(a[-1].size) or plain(*a))
            return variational.e_steps(bag, alpha, beta)[0], sum(calls)

    settled = fitted(0.0, 1e-9, 5000)[0]
    (old, most), (new, few) = fitted(0.0, variational.TOL, 60), fitted(variational.BEYOND, variational.TOL, 60)
    assert few < 0.8 * most and np.abs(new - settled).sum() < np.abs(old - settled).sum()


def test_biterms_of_a_document_are_summed_in_place(spark):
    """Sums over the pairs that documents' tokens make equal those over rows of pairs, also where words are pruned in between."""
    rng, v, k, window = np.random.default_rng(6), 9, 3, 4
    texts = [[f"w{j}" for j in rng.integers(0, 12, rng.integers(1, 30))] for _ in range(20)]
    frame = readers.from_tokens(spark, texts)
    phi, mix = rng.dirichlet(np.ones(v), k), rng.dirichlet(np.ones(k))
    tokens = [[(p, int(w[1:])) for p, w in enumerate(t) if int(w[1:]) < v] for t in texts]
    pos, i = (np.array([x[j] for t in tokens for x in t]) for j in range(2))
    own = np.repeat(np.arange(20), [len(t) for t in tokens])
    got, like = mixture.biterm_shares(pos, i, own, window, phi, mix)
    assert len(pos) < sum(map(len, texts))
    words, want = np.zeros((k, v)), 0.0
    for r in documents.biterms(frame, window).collect():
        a, b = int(r["w1"][1:]), int(r["w2"][1:])
        if max(a, b) < v:
            p = mix * phi[:, a] * phi[:, b]
            want += r["n"] * np.log(p.sum())
            for w in (a, b):
                words[:, w] += r["n"] * p / p.sum()
    assert np.isclose(like, want) and np.allclose(np.array([np.bincount(i, x, v) for x in got]), words)
