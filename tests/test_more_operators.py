import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import cli
from lexmill.functions import bases
from lexmill.operators import documents, topics, vocabulary
from lexmill.sources.readers import from_tokens


def test_splines_and_levels(spark):
    x = np.linspace(0, 10, 41)
    df = spark.createDataFrame([(i, float(v), "ab"[i % 2]) for i, v in enumerate(x)], "doc_id long, x double, g string")
    d, names = bases.design(df, {"s": bases.b_spline(F.col("x"), [3.0, 6.0], 0.0, 10.0)})
    m = np.array([list(r)[1:] for r in d.orderBy("doc_id").collect()])
    assert names[0] == "s1" and m.shape == (41, 6) and np.allclose(m.sum(axis=1), 1) and (m >= 0).all()
    n = np.array([list(r) for r in df.orderBy("doc_id").select(*bases.natural_spline(F.col("x"), [1, 4, 6, 9])).collect()])
    assert n.shape == (41, 3) and np.allclose(np.diff(n[x >= 9], 2, axis=0), 0, atol=1e-9)
    hot, names = bases.one_hot(df, "g")
    assert names == ["g[b]"] and hot.agg(F.sum("`g[b]`")).first()[0] == 20


def test_distributions_and_draws(spark):
    d = from_tokens(spark, [["a", "a", "b"], ["c", "c"], ["z"]])
    w = spark.createDataFrame([(0, "a", 1.0), (0, "b", 0.5), (1, "c", 1.0)], "topic int, word string, weight double")
    got = {(r["doc_id"], r["topic"]): r["p"] for r in topics.approximate_distribution(documents.token_windows(d, 2, 1), w, w).collect()}
    assert got[0, 0] == 1 and got[1, 1] == 1 and got[2, 0] == got[2, 1] == 0.5
    draws = spark.createDataFrame([(s, i, 0, 0.1 * s + 0.01 * i) for s in range(4) for i in range(5)], "draw int, doc_id long, topic int, p double")
    meta = spark.createDataFrame([(i, "g") for i in range(5)], "doc_id long, g string")
    r = topics.prevalence_with_draws(draws, meta, "g").first()
    means = [0.1 * s + 0.02 for s in range(4)]
    assert math.isclose(r["mean"], np.mean(means)) and math.isclose(r["se"], math.sqrt(np.var([0.01 * i for i in range(5)], ddof=1) / 5 + 1.25 * np.var(means, ddof=1)))
    q = topics.draw_quantiles(draws).first()
    assert math.isclose(q["low"], np.quantile(means, 0.025))


def test_labels_and_contrast(spark):
    lab = spark.createDataFrame([(i, t) for i, t in enumerate([0, 1, 2, 3, 4, -1])], "doc_id long, topic int")
    got = [r["topic"] for r in topics.merge_labels(lab, [[3, 1], [1, 0]]).orderBy("doc_id").collect()]
    assert got == [0, 0, 1, 0, 2, -1]
    top = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "a"), (1, 2, "b")], "topic int, rank int, word string")
    assert topics.pair_diversity(top).first()[0] == 0.5
    phi = spark.createDataFrame([(0, "a", 0.9), (0, "b", 0.1), (1, "a", 0.2), (1, "b", 0.8)], "topic int, word string, p double")
    theta = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5)], "doc_id long, topic int, p double")
    words = spark.createDataFrame([(0, "a", 11)], "doc_id long, word string, n long")
    c = {r["topic"]: r["weight"] for r in topics.contrastive_words(words, theta, phi, spark.createDataFrame([(0, "g")], "doc_id long, g string"), "g").collect()}
    assert math.isclose(c[0], 9) and math.isclose(c[1], 2)
    assert all(math.isclose(r["s"], 1) for r in topics.shrink(phi).groupBy("topic").agg(F.sum("p").alias("s")).collect())
    vocab = vocabulary.vocabulary(from_tokens(spark, [["a", "b", "b"]]))
    assert topics.label_topics(phi, vocab, 1).count() == 8


def test_jobs(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("\n".join(["apple banana cherry apple", "river stone water river"] * 10))
    cli.main(["preprocess", "--input", str(tmp_path / "in.txt"), "--output", str(tmp_path / "c"), "--min-df", "2"])
    cli.main(["train", "--input", str(tmp_path / "c"), "--output", str(tmp_path / "m"), "--topics", "2", "--iters", "5"])
    cli.main(["analyze", "--input", str(tmp_path / "c"), "--show", "3"])
    cli.main(["show", "--input", str(tmp_path / "m"), "--show", "3"])
    said = capsys.readouterr().out
    assert "apple" in said and "frequent" in said


def test_too_many_groups_topics_or_levels_are_an_error(spark):
    from lexmill.functions import bases
    from lexmill.operators import cooccurrence, effects

    many = spark.range(10_001).select(F.col("id").alias("doc_id"), F.col("id").alias("topic"), F.lit(0.5).alias("p"), F.col("id").alias("g"), F.array(F.lit("a"), F.lit("b")).alias("tokens"))
    topics = spark.createDataFrame([(0, 1, "a"), (0, 2, "b")], "topic int, rank int, word string")
    with pytest.raises(ValueError, match="1000 groups"):
        cooccurrence.coherence_over(many.where("g <= 1000"), topics, "g")
    with pytest.raises(ValueError, match="10,000 topics"):
        effects.topic_effects(many.select("doc_id", "topic", "p"), many.select("doc_id", "g"), ["g"])
    with pytest.raises(ValueError, match="1000 levels"):
        bases.one_hot(many.where("g <= 1000"), "g")
