"""Operators on small corpora with results worked out by hand or by plain Python."""

import math
import random
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import agreement, cooccurrence, crossval, documents, effects, embedding, threads, topics, vocabulary, weights
from lexmill.sources.readers import from_texts, from_tokens


def column(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(expr).collect()]


def test_tokenise(spark):
    got = column(spark, T.tokenize(F.col("x")), "Don't stop-me A b2c ex. U.S.A naïve ΟΔΟΣ", None, "")
    assert got[0] == ["don't", "stop-me", "ex", "u.s.a", "naïve", "οδος"] and got[1:] == [[], []]
    assert column(spark, T.tokenize(F.col("x"), stopwords=["the"], min_length=4), "The them a THE there")[0] == ["them", "there"]
    assert column(spark, T.tokenize(F.col("x"), lowercase=False, stopwords=["the"]), "The the")[0] == ["The"]


def test_text_functions(spark):
    assert column(spark, T.strip_web(F.col("x")), "<p>see HTTPS://a.b/c?d now</p>&nbsp;x &#39;y")[0].split() == ["see", "now", "x", "y"]
    assert column(spark, T.strip_quotes(F.col("x")), "<i>no</i>mine<p>> quoted\n&gt; too<p>A &amp; B")[0] == "mine A & B"
    assert column(spark, T.sentences(F.col("x")), "One. Two?! three", "  ", None) == [["One.", "Two?!", "three"], [], []]
    assert column(spark, T.is_numeric(F.col("x")), "12", "1a") == [True, False]
    assert column(spark, T.mostly_non_alpha(F.col("x")), "a--", "ab-") == [True, False]
    assert column(spark, T.label_string(F.col("x").cast("double")), "3.0", "2.5") == ["3", "2.5"]
    assert T.sparkline([0, 1, 2]) == "▁▅█"


def test_vocabulary_and_prune(spark):
    d = from_tokens(spark, [["a", "b", "a"], ["x"], ["a", "b"], ["y"], ["b", "a", "c"]])
    v = {r["word"]: (r["cf"], r["df"]) for r in vocabulary.vocabulary(d).collect()}
    assert v == {"a": (4, 3), "b": (3, 3), "c": (1, 1), "x": (1, 1), "y": (1, 1)}
    keep = vocabulary.prune(vocabulary.vocabulary(d), 5, min_df=2)
    assert sorted(r["word"] for r in keep.collect()) == ["a", "b"]
    kept = vocabulary.transform(d, keep)
    assert {r["doc_id"]: r["tokens"] for r in kept.collect()} == {0: ["a", "b", "a"], 2: ["a", "b"], 4: ["b", "a"]}
    assert sorted(r["doc_id"] for r in vocabulary.dropped_documents(d, kept).collect()) == [1, 3]
    assert [r["word"] for r in vocabulary.prune(vocabulary.vocabulary(d), 5, rm_top=1, max_features=2).collect()] == ["b", "c"]
    assert sorted(r["word"] for r in vocabulary.prune(vocabulary.vocabulary(d), 5, max_df=0.4).collect()) == ["c", "x", "y"]
    assert vocabulary.document_limits(10, 0.25, 0.5) == (3, 0.5) and vocabulary.document_limits(10, 2, 5) == (2, 0.5)
    curve = {r["threshold"]: (r["words"], r["tokens"], r["docs"]) for r in vocabulary.removal_curve(d, vocabulary.vocabulary(d), [1, 2, 4]).collect()}
    assert curve == {1: (0, 0, 0), 2: (3, 3, 2), 4: (5, 10, 5)}
    oov = {r["doc_id"]: r["oov"] for r in vocabulary.oov_rate(d, keep).collect()}
    assert oov[0] == 0 and oov[1] == 1 and abs(oov[4] - 1 / 3) < 1e-12


def test_chunks(spark):
    d = from_tokens(spark, [[str(i) for i in range(11)], [], ["a", "b"]])
    got = {(r["parent"], r["chunk"]): len(r["tokens"]) for r in documents.chunk_tokens(d, 5, 2).collect()}
    assert got == {(0, 0): 5, (0, 1): 6, (1, 0): 0, (2, 0): 2}
    t = from_texts(spark, ["a b. c d e. f g h i j k l. m.", "one."])
    got = [(r["parent"], r["text"]) for r in documents.chunk_sentences(t, 5, 2).orderBy("parent", "chunk").collect()]
    assert got == [(0, "a b. c d e."), (0, "f g h i j"), (0, "k l. m."), (1, "one.")]


def test_top_biterms_leave_rare_words_out_exactly(spark, monkeypatch):
    rng = random.Random(5)
    texts = [[f"w{int(rng.paretovariate(0.7))}" for _ in range(40)] for _ in range(60)]
    every = Counter(tuple(sorted((t[x], t[y]))) for t in texts for x in range(40) for y in range(x + 1, min(x + 5, 40)))
    want = sorted(((a, b, m) for (a, b), m in every.items()), key=lambda r: (-r[2], r[:2]))[:10]
    for lead, listed in ((20, 50_000), (3, 50_000), (20, 2)):  # the bound holds; too few leading words; too many words left
        monkeypatch.setattr(documents, "LEADING", lead)
        monkeypatch.setattr(documents, "LISTED", listed)
        assert [tuple(r) for r in documents.top_biterms(from_tokens(spark, texts), 10, 5).collect()] == want


def test_sentence_chunks_fold_numbers_only(spark):
    """A fold that copied its words for each sentence took minutes here."""
    t = from_texts(spark, [" ".join(f"w{i} x y." for i in range(40_000)), "a. " * 7, " ".join(map(str, range(240))), ""])
    start = time.monotonic()
    got = {(r["parent"], r["chunk"]): r["text"].split() for r in documents.chunk_sentences(t, 120, 30).collect()}
    assert time.monotonic() - start < 30
    assert [len(got[0, i]) for i in range(1000)] == [120] * 1000 and got[0, 999][0] == f"w{999 * 40}" and got[1, 0] == ["a."] * 7
    assert [len(got[2, i]) for i in range(2)] == [120, 120] and got[3, 0] == [] and len(got) == 1004


def test_ngrams_and_phrases(spark):
    d = from_tokens(spark, [["a", "b", "c"], ["x"], []])
    assert [r["tokens"] for r in documents.ngrams(d, 1, 3).orderBy("doc_id").collect()] == [["a", "b", "c", "a_b", "b_c", "a_b_c"], ["x"], []]
    rng = random.Random(0)
    texts = []
    for _ in range(200):
        w = [f"w{rng.randrange(50)}" for _ in range(10)]
        at = rng.randrange(11)
        texts.append(w[:at] + ["new", "york"] + w[at:])
    d = from_tokens(spark, texts)
    p = {(r["a"], r["b"]): r for r in documents.learn_phrases(d, 5, 0.0).collect()}
    assert p["new", "york"]["n_ab"] == 200 and math.isclose(p["new", "york"]["score"], 195 * 52 / 40000)
    npmi = documents.learn_phrases(d, 5, 0.5, "npmi").collect()
    assert [(r["a"], r["b"]) for r in npmi] == [("new", "york")]
    joined = documents.apply_phrases(d, documents.learn_phrases(d, 5, 0.5, "npmi"))
    assert joined.where(F.array_contains("tokens", "new_york")).count() == 200
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c")], "a string, b string")
    got = documents.apply_phrases(from_tokens(spark, [["a", "b", "c"], ["c", "c", "c", "c", "b", "c"], ["q"]]), pairs).orderBy("doc_id").collect()
    assert [r["tokens"] for r in got] == [["a_b", "c"], ["c_c", "c_c", "b_c"], ["q"]]


def test_phrases_in_long_documents(spark, monkeypatch):
    """Both ways of the join, null ids, and a row of 200,000 tokens with as many known pairs, whose cost once grew with its square."""
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a")], "a string, b string")
    d = spark.createDataFrame([(None, ["a", "b", "a"]), (1, ["x"]), (2, ["a", "b"] * 100_000), (3, ["y", "a", "a", "a", "z", "b", "a"])], "doc_id long, tokens array<string>")
    for most in (10, 0):
        monkeypatch.setattr(documents, "BROADCAST_PHRASES", most)
        start = time.monotonic()
        got = {r["doc_id"]: r["tokens"] for r in documents.apply_phrases(d, pairs).collect()}
        assert time.monotonic() - start < 60
        assert got == {None: ["a_b", "a"], 1: ["x"], 2: ["a_b"] * 100_000, 3: ["y", "a_a", "a", "z", "b_a"]}


def test_biterms_and_splits(spark):
    rng = random.Random(1)
    texts = [[rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(20)]
    want = {}
    for i, t in enumerate(texts):
        for x, y in combinations(range(len(t)), 2):
            if y - x < 4:
                k = (i, *sorted((t[x], t[y])))
                want[k] = want.get(k, 0) + 1
    d = from_tokens(spark, texts)
    assert {(r["doc_id"], r["w1"], r["w2"]): r["n"] for r in documents.biterms(d, 4).collect()} == want
    every = {}
    for (_, a, b), n in want.items():
        every[a, b] = every.get((a, b), 0) + n
    for n in (3, 100):
        assert [tuple(r) for r in documents.top_biterms(d, n, 4).collect()] == sorted(((a, b, m) for (a, b), m in every.items()), key=lambda r: (-r[2], r[:2]))[:n]
    split = {r["doc_id"]: (r["estimate"], r["score"]) for r in documents.even_odd(d).collect()}
    assert split == {i: (t[::2], t[1::2]) for i, t in enumerate(texts) if len(t) > 1}
    held = documents.heldout(d, 1.0, 0.5).collect()
    assert all(len(r["missing"]) == len(texts[r["doc_id"]]) // 2 and sorted(r["kept"] + r["missing"]) == sorted(texts[r["doc_id"]]) for r in held)


def windows(texts, w):
    out = []
    for t in texts:
        out += [set(t)] if 0 < len(t) <= w else [set(t[i : i + w]) for i in range(len(t) - w + 1)] if t else []
    return out


@pytest.mark.parametrize("w", [2, 5, 40])
def test_window_counts_match_plain_windows(spark, w):
    rng = random.Random(w)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))] for _ in range(25)]
    top = spark.createDataFrame([(0, i + 1, x) for i, x in enumerate("abc")] + [(1, i + 1, x) for i, x in enumerate("cde")], "topic int, rank int, word string")
    n, occ, co = cooccurrence.window_counts(from_tokens(spark, texts), top, w)
    ws = windows(texts, w)
    assert n == len(ws)
    assert {r["word"]: r["occ"] for r in occ.collect()} == {x: k for x in "abcde" if (k := sum(x in s for s in ws))}
    want = {p: sum(p[0] in s and p[1] in s for s in ws) for t in ("abc", "cde") for p in combinations(t, 2)}
    assert {(r["w1"], r["w2"]): r["co"] for r in co.collect()} == {k: v for k, v in want.items() if v}


def test_coherence_prefers_planted_topic(spark):
    rng = np.random.default_rng(0)
    texts = []
    for _ in range(300):
        t = (["a", "b", "c"] * 3 if rng.random() < 0.5 else []) + [f"r{i}" for i in rng.integers(0, 200, 6)]
        texts.append([t[i] for i in rng.permutation(len(t))])
    d = from_tokens(spark, texts)
    top = spark.createDataFrame([(0, i + 1, w) for i, w in enumerate(["a", "b", "c"])] + [(1, i + 1, w) for i, w in enumerate(["r1", "r2", "r3"])], "topic int, rank int, word string")
    for m in ("u_mass", "c_uci", "c_npmi", "c_v", "npmi_doc"):
        s = {r["topic"]: r["score"] for r in cooccurrence.coherence(d, top, m).collect()}
        assert s[0] > s[1], m
    assert 0.9 < {r["topic"]: r["score"] for r in cooccurrence.coherence(d, top, "c_v").collect()}[0] <= 1.0
    boot = {r["topic"]: r for r in cooccurrence.coherence_bootstrap(d, top, 20).collect()}
    assert boot[0]["low"] <= boot[0]["mean"] <= boot[0]["high"]
    sliced = cooccurrence.coherence_over(d.withColumn("s", F.col("doc_id") % 2), top, "s")
    assert sliced.count() == 2


def test_weights(spark):
    d = from_tokens(spark, [["a", "a", "b"], ["b", "c"], ["c"]], g=["x", "x", "y"])
    w = {(r["doc_id"], r["word"]): r["weight"] for r in weights.tfidf(d).collect()}
    a, b = 2 * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    assert math.isclose(w[0, "a"], a / math.hypot(a, b)) and math.isclose(w[2, "c"], 1)
    c = {(r["class"], r["word"]): r["weight"] for r in weights.ctfidf(weights.class_counts(d, "g")).collect()}
    assert math.isclose(c["x", "a"], 2 * math.log(1 + 3 / 2)) and math.isclose(c["y", "c"], math.log(1 + 3 / 2))
    z = {r["word"]: r["z"] for r in weights.fighting_words(d, "g", "x", "y").collect()}
    assert z["a"] > 0 > z["c"]


def test_topics(spark):
    phi = spark.createDataFrame([(0, "a", 0.7), (0, "b", 0.2), (0, "c", 0.1), (1, "a", 0.1), (1, "b", 0.2), (1, "c", 0.7)], "topic int, word string, p double")
    theta = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.1), (2, 0, 0.2), (2, 1, 0.8), (3, 0, 0.5), (3, 1, 0.5)], "doc_id long, topic int, p double")
    best = {r["topic"]: r["word"] for r in vocabulary.top_words(topics.frex(phi), "topic", "score", 1).collect()}
    assert best == {0: "a", 1: "c"}
    n = {r["topic"]: (r["docs"], round(r["mass"], 6)) for r in topics.sizes(theta).collect()}
    assert n == {0: (2, 1.6), 1: (1, 1.4)}  # a tie goes to the first topic
    r = topics.correlation(theta).first()
    assert math.isclose(r["r"], -1)
    assert [(x["topic"], x["doc_id"]) for x in topics.find_thoughts(theta, 1).orderBy("topic").collect()] == [(0, 1), (1, 2)]
    assert math.isclose(topics.significance(phi).where("topic = 0").first()["kl"], sum(p * math.log(3 * p) for p in (0.7, 0.2, 0.1)))
    bag = spark.createDataFrame([(1, "a", 2), (2, "c", 1), (2, "zzz", 5)], "doc_id long, word string, n long")
    p = topics.perplexity(bag, phi, theta).first()
    want = 2 * math.log(0.9 * 0.7 + 0.1 * 0.1) + math.log(0.2 * 0.1 + 0.8 * 0.7)
    assert p["tokens"] == 3 and math.isclose(p["log_likelihood"], want)
    same = spark.createDataFrame([(t, i + 1, w) for t in (0, 1) for i, w in enumerate("abc")], "topic int, rank int, word string")
    assert topics.inverted_rbo(same).first()[0] < 1e-9 and topics.diversity(same).first()[0] == 0.5
    apart = spark.createDataFrame([(t, i + 1, w + str(t)) for t in (0, 1) for i, w in enumerate("abc")], "topic int, rank int, word string")
    assert topics.inverted_rbo(apart).first()[0] == 1.0


def test_effects_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 2))
    y = 1 + x @ [2, -1] + rng.standard_normal(200) * (1 + (x[:, 0] > 0))
    g = np.arange(200) % 10
    df = spark.createDataFrame([(float(a), float(b), float(c), int(k)) for a, b, c, k in zip(x[:, 0], x[:, 1], y, g, strict=True)] + [(None, 1.0, 1.0, 0)], "x0 double, x1 double, y double, g int")
    xx = np.column_stack((np.ones(200), x))
    inv = np.linalg.inv(xx.T @ xx)
    beta = inv @ xx.T @ y
    e = y - xx @ beta
    fit = effects.ols(df, "y", ["x0", "x1"])
    assert np.allclose(fit["beta"], beta) and np.allclose(fit["cov"], inv * (e @ e) / 197) and fit["n"] == 200
    hc1 = effects.ols(df, "y", ["x0", "x1"], robust="hc1")
    assert np.allclose(hc1["cov"], inv @ (xx.T * e**2) @ xx @ inv * 200 / 197)
    cr = effects.ols(df, "y", ["x0", "x1"], cluster="g")
    s = np.array([(xx[g == k].T @ e[g == k]) for k in range(10)])
    assert np.allclose(cr["cov"], inv @ s.T @ s @ inv * 10 / 9 * 199 / 197)
    z = (y > 1).astype(float)
    logit = effects.glm(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x[:, 0], z, strict=True)], "x0 double, z double"), "z", ["x0"])
    b = np.array(logit["beta"])
    xl = xx[:, :2]
    assert np.abs(xl.T @ (z - 1 / (1 + np.exp(-xl @ b)))).max() < 1e-6
    pooled = effects.pool([fit, fit])
    assert np.allclose(pooled["beta"], beta) and np.allclose(pooled["cov"], fit["cov"])


def test_agreement(spark):
    score = lambda rows: agreement.agreement(spark.createDataFrame(rows, "a int, b int"), "a", "b").first().asDict()
    same = score([(i % 3, (i % 3) * 7) for i in range(30)])
    assert all(math.isclose(same[k], 1) for k in ("purity", "ari", "nmi", "homogeneity", "completeness", "v_measure"))
    assert score([(0, 0), (0, 0)])["ari"] == 1.0
    mixed = score([(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (-1, 0), (None, 1)])
    assert mixed["n"] == 5 and math.isclose(mixed["purity"], 0.8)


def test_embeddings(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [0.0, 1.0], 1), (3, [0.1, 0.9], 1)], "vec_id long, embedding array<double>, label int")
    c = {r["label"]: r["centroid"] for r in embedding.centroids(v, "label").collect()}
    assert np.allclose(c[0], [0.95, 0.05]) and np.allclose(c[1], [0.05, 0.95])
    near = {(r["query"], r["rank"]): r["id"] for r in embedding.cosine_top_k(v, v, 2).collect()}
    assert near[0, 1] == 1 and near[2, 1] == 3 and len(near) == 8
    assert {r["vec_id"]: r["label"] for r in embedding.nearest_centroid(v, embedding.centroids(v, "label"), "label").collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    cand = spark.createDataFrame([(0, "a", 1.0, [1.0, 0.0]), (0, "b", 0.99, [1.0, 0.01]), (0, "c", 0.8, [0.0, 1.0])], "topic int, word string, relevance double, embedding array<double>")
    assert [r["word"] for r in embedding.mmr(cand, 2, 0.5).orderBy("rank").collect()] == ["a", "c"]


def test_threads(spark):
    posts = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (5, 99), (6, 7), (7, 6)] + [(100 + i, 99 + i if i else None) for i in range(30)], "id long, parent long")
    s = {r["id"]: (r["root"], r["depth"], r["has_child"]) for r in threads.structure(posts).collect()}
    assert s[1] == (1, 0, True) and s[3] == (1, 2, False) and s[4] == (1, 1, False) and s[5] == (5, 0, False)
    assert s[6][:2] == (None, None) and s[129] == (100, 29, False)
    d = from_tokens(spark, ["a b c d e f g".split(), "x a b c d e y".split(), []])
    p = spark.createDataFrame([(0, None), (1, 0), (2, 0)], "doc_id long, parent long")
    assert [r["tokens"] for r in threads.strip_copied(d, p, 5).orderBy("doc_id").collect()] == ["a b c d e f g".split(), ["x", "y"], []]
    shuffled = {r["id"]: r["parent"] for r in threads.shuffle_parents(posts.where("id < 6")).collect()}
    assert set(shuffled) == {1, 2, 3, 4, 5} and shuffled[3] == 2


def test_folds(spark):
    d = spark.createDataFrame([(i, f"g{i % 7}", i // 3) for i in range(60)], "doc_id long, g string, t int")
    k = crossval.kfold(d, 5).groupBy("fold").count()
    assert k.count() == 5 and k.agg(F.sum("count")).first()[0] == 60
    grouped = crossval.kfold(d, 3, by="g").join(d, "doc_id").groupBy("g").agg(F.countDistinct("fold").alias("n"))
    assert grouped.agg(F.max("n")).first()[0] == 1
    sizes = [r["count"] for r in crossval.balanced_groups(d, "g", 3).groupBy("fold").count().collect()]
    assert sum(sizes) == 60 and max(sizes) - min(sizes) <= 10
    t = crossval.temporal(d, "t", 3).join(d, "doc_id")
    for f in (1, 2, 3):
        train = t.where(f"fold = {f} and role = 'train'").agg(F.max("t")).first()[0]
        test = t.where(f"fold = {f} and role = 'test'").agg(F.min("t")).first()[0]
        assert train < test
    scores = crossval.cross_validate(d, crossval.kfold(d, 3), lambda x: x.count(), lambda m, x: m + x.count(), 3)
    assert scores == [60, 60, 60]
