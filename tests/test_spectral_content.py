"""Anchors by projection, sparse deviations of groups' wording, and the models that start from or use them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import models as M
from lexmill.models import content, spectral
from lexmill.sources import readers
from tests.test_models import blocks, planted


@pytest.fixture(scope="module")
def mixed(spark):
    """Documents that mix three topics of eight words each; every topic has an anchor word of its own, all share a few."""
    rng = np.random.default_rng(4)
    docs = []
    for _ in range(300):
        share = rng.dirichlet([0.3] * 3)
        docs.append([f"w{b}{rng.integers(8)}x" if rng.random() < 0.8 else f"shared{rng.integers(6)}" for b in rng.choice(3, size=40, p=share)])
    return readers.from_tokens(spark, docs).persist()


def test_projection_keeps_the_matrix(spark, mixed):
    c = M.Corpus(mixed)
    v = c.size
    q = np.zeros((v, v))
    for r in c.rows.collect():
        n = np.zeros(v)
        n[r["i"]] = r["n"]
        t = n.sum()
        q += (np.outer(n, n) - np.diag(n)) / (t * (t - 1))
    rows, mass, df = spectral.projected(c, 100)
    r = np.hstack([spectral.signs(0, k, v, min(64, 100 - 64 * k)) for k in range(2)])
    assert np.allclose(rows, q @ r, atol=1e-3) and np.allclose(mass, q.sum(axis=1))
    assert (df == [sum(w in t for t in ({*x["tokens"]} for x in mixed.collect())) for w in c.words]).all()


def test_only_possible_anchors_rows_are_sent(spark, mixed):
    c = M.Corpus(mixed)
    rows, mass, df = spectral.projected(c, 100)
    able = df > np.median(df)
    few = spectral.projected(c, 100, able=able)[0]
    assert len(few) == able.sum() < len(rows) and np.allclose(few, rows[able], atol=1e-4)
    corners = few[:3]
    assert np.allclose(spectral.against(c, corners), rows @ corners.T, rtol=1e-4, atol=1e-3)
    scaled = rows / mass[:, None] / 10
    at = np.flatnonzero(able)[spectral.pick(scaled[able], np.ones(able.sum(), bool), 3)]
    want = spectral.mixtures_of(scaled, scaled[at]) * mass[:, None]
    phi, anchors = spectral.anchor_topics(c, 3, 100, int(np.median(df)) + 1)
    assert anchors == at.tolist() and np.allclose(phi, (want / want.sum(axis=0)).T, atol=2e-3)


def test_unaligned_languages_start_apart(spark):
    rng = np.random.default_rng(0)
    docs = [[f"{lang}:w{min(int(rng.exponential(6)), 29)}" for _ in range(40)] for lang in ("a", "b", "c") for _ in range(60)]
    m = M.PolylingualLDA(3, iters=20).fit(M.Corpus(readers.from_tokens(spark, docs)))
    lead = {}
    for r in m.theta.collect():
        lead.setdefault(int(str(r["doc_id"])) // 60, np.zeros(3))[r["topic"]] += r["p"] / 60
    assert sorted(int(x.argmax()) for x in lead.values()) == [0, 1, 2] and min(x.max() for x in lead.values()) > 0.8


def test_mixtures_of_corners():
    rng = np.random.default_rng(0)
    corners, want = rng.normal(size=(4, 30)), rng.dirichlet(np.ones(4), 50)
    assert np.allclose(spectral.mixtures_of(want @ corners, corners, 3000, 0), want, atol=0.01)


def test_anchor_topics_are_found(spark, mixed):
    m = M.AnchorLDA(3, width=128).fit(mixed)
    assert len(blocks(m.top_words())) == 3


def test_stm_starts_from_anchors(spark, mixed):
    a, b = (M.STM(3, init=i, iters=20) for i in ("spectral", "lda"))
    ma, mb = a.fit(M.Corpus(mixed)), b.fit(M.Corpus(mixed))
    assert len(blocks(ma.top_words())) == 3
    assert ma.fit_history[-1][1] > mb.fit_history[-1][1] - 0.02 * abs(mb.fit_history[-1][1])
    with pytest.raises(ValueError):
        M.STM(3, init="other")


def test_sparse_regression_finds_planted_deviations():
    rng, design = np.random.default_rng(1), content.Design(3, 2)
    coef = np.zeros((40, len(design)))
    coef[:10, 0], coef[10:20, 4], coef[20:25, 5 + 3] = 1.0, -1.0, 1.5  # a topic, a group, a topic in a group
    exposure = rng.uniform(200, 400, (40, 6))
    counts = rng.poisson(exposure * np.exp(design.expand(coef))).astype(float)
    got, _ = content.regress(counts, exposure, design, np.array([64.0, 16.0, 4.0, 1.0]))
    fitted = design.expand(got)
    assert np.abs(fitted - design.expand(coef)).max() < 0.35
    assert (got != 0).mean() < 0.5 and np.abs(fitted[25:]).mean() < 0.05


def test_regression_meets_its_conditions():
    """At the optimum the slope of the likelihood equals the penalty where a coefficient isn't 0, and is below it elsewhere."""
    rng, design = np.random.default_rng(2), content.Design(2, 2)
    exposure = rng.uniform(5, 20, (30, 4))
    counts = rng.poisson(exposure * rng.uniform(0.3, 3, (30, 4))).astype(float)
    coef, _ = content.regress(counts, exposure, design, np.array([2.0]), sweeps=3000, tol=1e-10)
    mu = exposure * np.exp(design.expand(coef))
    slope = np.stack([(counts - mu)[:, c].sum(axis=1) for c in design.covers], axis=1)
    on = coef != 0
    assert np.allclose(slope[on], 2 * np.sign(coef[on]), atol=1e-3) and (np.abs(slope[~on]) <= 2 + 1e-3).all()


def test_content_of_groups(spark):
    """Two groups word each topic alike but for one word of theirs; the sparse model finds these words."""
    rng, rows = np.random.default_rng(3), []
    for i in range(300):
        b, g = i % 3, i % 2
        rows.append((i, [f"own{g}t{b}" if rng.random() < 0.25 else f"w{b}{rng.integers(8)}x" for _ in range(30)], "ab"[g]))
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>, group string")
    m = M.STM(3, groups=["a", "b"], content="sparse", iters=25)
    model = m.fit(M.Corpus(docs, carry=("group",)))
    at = {w: i for i, w in enumerate(model.words)}
    for b in range(3):
        k = max(range(3), key=lambda k, b=b: model.topic_word[k, [at[f"w{b}{j}x"] for j in range(8)]].sum())
        for g, own, other in (("a", f"own0t{b}", f"own1t{b}"), ("b", f"own1t{b}", f"own0t{b}")):
            p = m.group_words[g][k]
            assert p[at[own]] > 5 * p[at[other]]
    assert np.allclose(m.beta.sum(axis=2), 1) and (m.kappa == 0).mean() > 0.3


def test_planted_rows_without_cooccurrence(spark):
    docs = readers.from_tokens(spark, [["one"], ["two"], *planted(n=30)])
    assert M.AnchorLDA(3, min_df=1).fit(docs).theta.agg(F.count("*")).first()[0] > 0


def test_words_of_groups_leave_the_driver_some_blocks_at_a_time(spark, monkeypatch):
    """Deviations and shares are those of all words' regressions together, whatever leaves the driver at a time."""
    rng, design = np.random.default_rng(7), content.Design(2, 3, False)
    stats = rng.gamma(0.5, 20.0, (3, 2, 50))
    cells = stats.transpose(2, 1, 0).reshape(50, 6)
    want, _ = content.regress(cells, np.outer(cells.sum(axis=1) / cells.sum(), cells.sum(axis=0)), design, np.array([4.0, 1.0]))
    monkeypatch.setattr(content, "WORDS", 8)
    monkeypatch.setattr(content, "TOGETHER", 3)
    coef, shares = content.deviations(spark, stats, design, (1.0, 4.0))
    p = np.exp(design.expand(want) + np.log(cells.sum(axis=1))[:, None])
    assert coef.dtype == shares.dtype == np.float32 and np.allclose(coef, want, atol=1e-3)
    assert np.allclose(shares, (p / p.sum(axis=0)).reshape(50, 2, 3).transpose(2, 1, 0), atol=1e-4)


def test_all_languages_are_groups(spark, tmp_path, monkeypatch):
    """Languages beyond a hundred are groups too, and a group that the model wasn't told is an error, not the first group."""
    from lexmill.plans import model_queries

    rows = [(i, f"t{i % 5}x t{i % 7}y", f"l{i % 130:03}", "s") for i in range(260)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    told = []
    monkeypatch.setattr(model_queries.M, "STM", lambda *a, **kw: told.extend(kw["groups"]) or M.DMR(2, 1))
    monkeypatch.setattr(model_queries, "_fitted", lambda *a, **kw: None)
    monkeypatch.setattr(model_queries, "_corpus", lambda *a, **kw: None)
    model_queries.stm_content_fit(spark, str(tmp_path))
    assert len(told) == 131 and told[-1] == "?"
    docs = spark.createDataFrame([(i, ["a", "b"], "xy"[i % 2]) for i in range(6)], "doc_id long, tokens array<string>, group string")
    m = M.STM(2, groups=["x"], iters=1, init="lda")
    with pytest.raises(Exception, match="KeyError"):
        m.fit(M.Corpus(docs, carry=("group",)))
