"""Queries on topics, effects, embeddings, threads and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import crossval as CV
from ..operators import effects as E
from ..operators import embedding as EM
from ..operators import threads as TH
from ..operators import topics as TP
from ..operators import vocabulary as V
from .base import _PATTERN, CORPUS, TOPICS, bag, docs, phi, query, r6, table, theta, top_words

_T = f"WITH {CORPUS}, {TOPICS}"
_RANK = """, ex AS (SELECT topic, word, p, round(p / sum(p) OVER (PARTITION BY word), 12) AS e FROM phi),
rk AS (SELECT topic, word, p, (rank() OVER (PARTITION BY topic ORDER BY p) + (count(*) OVER (PARTITION BY topic, p) - 1) / 2) / count(*) OVER (PARTITION BY topic) AS f,
  (rank() OVER (PARTITION BY topic ORDER BY e) + (count(*) OVER (PARTITION BY topic, e) - 1) / 2) / count(*) OVER (PARTITION BY topic) AS x FROM ex)"""
_TOP10 = " SELECT topic, word, score, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, word) AS INTEGER) AS rank FROM w QUALIFY rank <= 10"


def _top(df):
    return V.top_words(df.select("topic", "word", r6("score").alias("score")), "topic", "score", 10)


@query(_T + " SELECT topic, word, round(p, 9) AS p FROM phi")
def phi_by_language(spark, sf_dir):
    return phi(docs(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query(_T + " SELECT doc_id, topic, round(p, 9) AS p FROM theta")
def theta_by_language(spark, sf_dir):
    return theta(docs(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query(_T + _RANK + ", w AS (SELECT topic, word, round(1 / (0.5 / f + 0.5 / x), 6) AS score FROM rk)" + _TOP10)
def frex_top(spark, sf_dir):
    return _top(TP.frex(phi(docs(spark, sf_dir))))


_SHARE = ", sh AS (SELECT word, cf / (SELECT sum(cf) FROM vocab) AS share FROM vocab)"


@query(_T + _SHARE + ", w AS (SELECT topic, word, round(p / share, 6) AS score FROM phi JOIN sh USING (word))" + _TOP10)
def lift_top(spark, sf_dir):
    d = docs(spark, sf_dir)
    return _top(TP.lift(phi(d), V.vocabulary(d)))


@query(_T + ", w AS (SELECT topic, word, round(p * (ln(greatest(p, 1e-12)) - avg(ln(greatest(p, 1e-12))) OVER (PARTITION BY word)), 6) AS score FROM phi)" + _TOP10)
def score_top(spark, sf_dir):
    return _top(TP.score(phi(docs(spark, sf_dir))))


@query(_T + _SHARE + ", w AS (SELECT topic, word, round(0.6 * ln(greatest(p, 1e-12)) + 0.4 * (ln(greatest(p, 1e-12)) - ln(greatest(share, 1e-12))), 6) AS score FROM phi JOIN sh USING (word))" + _TOP10)
def relevance_top(spark, sf_dir):
    d = docs(spark, sf_dir)
    return _top(TP.relevance(phi(d), V.vocabulary(d)))


@query(_T + _RANK + ", k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY p DESC, word) AS k FROM rk) SELECT topic, round(sum(1 / (0.7 / x + 0.3 / f)), 6) AS score FROM k WHERE k <= 10 GROUP BY topic")
def exclusivity(spark, sf_dir):
    return TP.exclusivity(phi(docs(spark, sf_dir))).withColumn("score", r6("score"))


@query(_T + " SELECT count(DISTINCT word) / count(*) AS diversity FROM top")
def topic_diversity(spark, sf_dir):
    return TP.diversity(top_words(docs(spark, sf_dir)))


@query(_T + """, pr AS (SELECT a.topic AS i, b.topic AS j FROM (SELECT DISTINCT topic FROM top) a JOIN (SELECT DISTINCT topic FROM top) b ON a.topic < b.topic),
st AS (SELECT i, j, d, (SELECT count(*) FROM top a JOIN top b ON a.word = b.word WHERE a.topic = pr.i AND b.topic = pr.j AND greatest(a.rank, b.rank) <= d) AS x FROM pr, (SELECT unnest(range(1, 11)) AS d)),
rb AS (SELECT i, j, sum(x / d * 0.9 ** d) * 0.1 / 0.9 + max(x) FILTER (d = 10) / 10 * 0.9 ** 10 AS rbo FROM st GROUP BY i, j) SELECT round(1 - avg(rbo), 6) AS inverted_rbo FROM rb""")
def inverted_rbo(spark, sf_dir):
    return TP.inverted_rbo(top_words(docs(spark, sf_dir))).select(r6("inverted_rbo").alias("inverted_rbo"))


_BEST = ", best AS (SELECT doc_id, topic FROM theta QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, topic) = 1)"


@query(_T + _BEST + ", n AS (SELECT topic, count(*) AS docs FROM best GROUP BY topic) SELECT topic, coalesce(docs, 0) AS docs, round(mass, 5) AS mass FROM (SELECT topic, sum(p) AS mass FROM theta GROUP BY topic) LEFT JOIN n USING (topic)")
def topic_sizes(spark, sf_dir):
    return TP.sizes(theta(docs(spark, sf_dir))).withColumn("mass", F.round("mass", 5))


@query(_T + ' SELECT source AS "group", topic, count(*) AS n, round(avg(p), 6) AS mean, round(coalesce(stddev_samp(p) / sqrt(count(*)), 0), 6) AS se FROM theta JOIN d USING (doc_id) GROUP BY source, topic')
def prevalence_by_group(spark, sf_dir):
    d = docs(spark, sf_dir)
    return TP.prevalence(theta(d), d, "source").withColumns({"mean": r6("mean"), "se": r6("se")})


@query(_T + ", m AS (SELECT doc_id % 4 AS time, topic, avg(p) AS m FROM theta GROUP BY doc_id % 4, topic) SELECT time, topic, round(m / sum(m) OVER (PARTITION BY time), 6) AS share FROM m")
def topics_over_time(spark, sf_dir):
    d = docs(spark, sf_dir)
    return TP.over_time(theta(d), d.withColumn("slice", F.col("doc_id") % 4), "slice").withColumn("share", r6("share"))


@query(_T + _BEST + " SELECT topic, source AS value, count(*) AS n FROM best JOIN d USING (doc_id) GROUP BY topic, source")
def topic_crosstab(spark, sf_dir):
    d = docs(spark, sf_dir)
    return TP.crosstab(theta(d), d, "source")


@query(_T + " SELECT x.topic AS a, y.topic AS b, round(corr(x.p, y.p), 6) AS r FROM theta x JOIN theta y ON x.doc_id = y.doc_id AND x.topic < y.topic GROUP BY x.topic, y.topic")
def topic_correlation(spark, sf_dir):
    return TP.correlation(theta(docs(spark, sf_dir))).withColumn("r", r6("r"))


@query(_T + " SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY round(p, 9) DESC, doc_id) AS INTEGER) AS rank, doc_id, round(p, 9) AS p FROM theta QUALIFY rank <= 5")
def find_thoughts(spark, sf_dir):
    return TP.find_thoughts(theta(docs(spark, sf_dir)).withColumn("p", F.round("p", 9)), 5)


@query(_T + " SELECT topic, round(p, 9) AS p FROM phi WHERE word = 'de'")
def topics_for_term(spark, sf_dir):
    return TP.topics_for_term(phi(docs(spark, sf_dir)), "de").withColumn("p", F.round("p", 9))


@query(_T + " SELECT topic, round(sum(p * ln(p)) + ln(count(*)), 6) AS kl FROM phi GROUP BY topic")
def significance_kl(spark, sf_dir):
    return TP.significance(phi(docs(spark, sf_dir))).withColumn("kl", r6("kl"))


_GROUPS = f"""WITH {CORPUS}, gt AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS g, lang AS topic, word, count(*) AS n FROM tokens WHERE lang IS NOT NULL GROUP BY ALL),
gp AS (SELECT g, topic, word, n / sum(n) OVER (PARTITION BY g, topic) AS p FROM gt)"""


def _group_phi(d):
    from pyspark.sql import Window

    n = d.where("lang is not null").select(F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("group"), F.col("lang").alias("topic"), F.explode("tokens").alias("word")).groupBy("group", "topic", "word").agg(F.count("*").alias("n"))
    return n.select("group", "topic", "word", (F.col("n") / F.sum("n").over(Window.partitionBy("group", "topic"))).alias("p"))


@query(_GROUPS + """, mix AS (SELECT topic, word, sum(p) / 2 AS m FROM gp GROUP BY topic, word), hm AS (SELECT topic, -sum(m * ln(m)) AS h FROM mix GROUP BY topic),
ho AS (SELECT topic, avg(h) AS h FROM (SELECT topic, g, -sum(p * ln(p)) AS h FROM gp GROUP BY topic, g) GROUP BY topic) SELECT topic, round((hm.h - ho.h) / ln(2), 6) AS js FROM hm JOIN ho USING (topic)""")
def js_polarization(spark, sf_dir):
    return TP.js_polarization(_group_phi(docs(spark, sf_dir))).withColumn("js", r6("js"))


@query(_GROUPS + ", d2 AS (SELECT topic, word, sqrt(coalesce(sum(p) FILTER (g = 'a'), 0)) AS s, sqrt(coalesce(sum(p) FILTER (g = 'b'), 0)) AS t FROM gp GROUP BY topic, word) SELECT topic, round(sqrt(sum((s - t) * (s - t)) / 2), 6) AS distance FROM d2 GROUP BY topic")
def content_hellinger(spark, sf_dir):
    return TP.hellinger(_group_phi(docs(spark, sf_dir)), "a", "b").withColumn("distance", r6("distance"))


@query(_T + """, c AS (SELECT topic, p - avg(p) OVER (PARTITION BY topic) AS x FROM theta), m AS (SELECT topic, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM c GROUP BY topic)
SELECT topic, round((m3 * m3 / (m2 * m2 * m2) + 1) / (m4 / (m2 * m2)), 5) AS bimodality FROM m""")
def bimodality(spark, sf_dir):
    return TP.bimodality(theta(docs(spark, sf_dir))).withColumn("bimodality", F.round("bimodality", 5))


@query(_T + " SELECT topic, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy FROM phi GROUP BY topic")
def topic_entropy(spark, sf_dir):
    return TP.entropy(phi(docs(spark, sf_dir))).withColumn("entropy", r6("entropy"))


_LIK = _T + """, b AS (SELECT doc_id, word, count(*) AS n FROM tokens GROUP BY doc_id, word),
pw AS (SELECT b.doc_id, b.word, any_value(b.n) AS n, sum(phi.p * theta.p) AS p FROM b JOIN phi ON phi.word = b.word JOIN theta ON theta.doc_id = b.doc_id AND theta.topic = phi.topic GROUP BY b.doc_id, b.word)"""


@query(_LIK + " SELECT CAST(sum(n) AS BIGINT) AS tokens, round(exp(-sum(n * ln(p)) / sum(n)), 4) AS perplexity FROM pw")
def perplexity_given_phi(spark, sf_dir):
    d = docs(spark, sf_dir)
    return TP.perplexity(bag(d), phi(d), theta(d)).select("tokens", F.round("perplexity", 4).alias("perplexity"))


@query(_LIK + " SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, round(-sum(n * ln(p)) / sum(n), 6) AS novelty FROM pw GROUP BY doc_id")
def document_residuals(spark, sf_dir):
    d = docs(spark, sf_dir)
    return TP.document_residuals(bag(d), phi(d), theta(d)).withColumn("novelty", r6("novelty"))


@query(f"""WITH {CORPUS}, x AS (SELECT CAST(len(toks) AS DOUBLE) AS y, CAST(doc_id % 7 AS DOUBLE) AS x FROM d), m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, regr_sxx(y, x) AS sxx, avg(x) AS mx FROM x),
e AS (SELECT sum((y - a - b * x) * (y - a - b * x)) AS rss FROM x, m)
SELECT 'intercept' AS term, round(a, 5) AS estimate, round(sqrt(rss / (n - 2) * (1 / n + mx * mx / sxx)), 5) AS se FROM m, e UNION ALL SELECT 'x', round(b, 5), round(sqrt(rss / (n - 2) / sxx), 5) FROM m, e""")
def ols_effect(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.size("tokens").alias("y"), (F.col("doc_id") % 7).alias("x"))
    return E.effect_table(spark, E.ols(d, "y", ["x"])).select("term", F.round("estimate", 5).alias("estimate"), F.round("se", 5).alias("se"))


@query(_T + """, g AS (SELECT source AS "group", count(*) AS n, avg(p) AS mean, var_pop(p) AS v FROM theta JOIN d USING (doc_id) WHERE topic = 'en' GROUP BY source)
SELECT "group", n, round(mean, 6) AS mean, round(sqrt(v / n * (SELECT sum(n) FROM g) / ((SELECT sum(n) FROM g) - (SELECT count(*) FROM g))), 6) AS se FROM g""")
def group_effect_hc1(spark, sf_dir):
    d = docs(spark, sf_dir)
    j = theta(d).where("topic = 'en'").join(d.select("doc_id", "source"), "doc_id")
    return E.group_effect(j, "p", "source").withColumns({"mean": r6("mean"), "se": r6("se")})


@query("""WITH c AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source),
r AS (SELECT a, sum(n) AS n, max(n) AS top FROM c GROUP BY a), k AS (SELECT b, sum(n) AS n FROM c GROUP BY b), t AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM c),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS p, (SELECT sum(n * (n - 1) / 2) FROM r) AS pa, (SELECT sum(n * (n - 1) / 2) FROM k) AS pb, (SELECT sum(top) FROM r) AS top, n,
  (SELECT -sum(n / t.n * ln(n / t.n)) FROM c) AS hc, (SELECT -sum(n / t.n * ln(n / t.n)) FROM r) AS ha, (SELECT -sum(n / t.n * ln(n / t.n)) FROM k) AS hb FROM t),
q AS (SELECT *, ha + hb - hc AS mi FROM s)
SELECT CAST(n AS BIGINT) AS n, round(top / n, 6) AS purity, round((p - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi,
  round(mi / hb, 6) AS homogeneity, round(mi / ha, 6) AS completeness, round(2 * (mi / hb) * (mi / ha) / (mi / hb + mi / ha), 6) AS v_measure FROM q""")
def cluster_agreement(spark, sf_dir):
    a = A.agreement(table(spark, sf_dir, "documents").select("lang", "source"), "lang", "source")
    return a.select("n", *[r6(c).alias(c) for c in a.columns if c != "n"])


@query("""WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m, count(*) AS n FROM x GROUP BY label, i)
SELECT label, max(n) AS n, round(sqrt(sum(m * m)), 6) AS length, round(first(m ORDER BY i), 6) AS first FROM m GROUP BY label""")
def centroids(spark, sf_dir):
    c = EM.centroids(table(spark, sf_dir, "embeddings"), "label")
    return c.select("label", "n", F.round(F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"), F.round(F.get("centroid", F.lit(0)), 6).alias("first"))


@query("""SELECT q.vec_id AS query, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) DESC, v.vec_id) AS INTEGER) AS rank, v.vec_id AS id,
  round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5""")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return EM.cosine_top_k(e.where("vec_id % 20 = 0"), e, 5).withColumn("cosine", r6("cosine"))


_CENTRES = """WITH x AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM x WHERE label IS NOT NULL GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label)"""


@query(_CENTRES + """, s AS (SELECT e.vec_id, c.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c) AS s FROM embeddings e, c WHERE e.embedding IS NOT NULL)
SELECT vec_id, label, round(s, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1""")
def nearest_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return EM.nearest_centroid(e, EM.centroids(e, "label"), "label").withColumn("cosine", r6("cosine"))


@query(_CENTRES + """, b AS (SELECT avg(list_distance(a.c, b.c)) AS d FROM c a JOIN c b ON a.label < b.label),
s AS (SELECT sqrt(avg(list_distance(CAST(e.embedding AS DOUBLE[]), c.c) ** 2)) AS s FROM embeddings e JOIN c USING (label))
SELECT round(d, 6) AS distance, round(d / s, 6) AS standardised FROM b, s""")
def embedding_polarization(spark, sf_dir):
    return EM.polarization(table(spark, sf_dir, "embeddings"), "label").select(r6("distance").alias("distance"), r6("standardised").alias("standardised"))


@query(_T + """, s AS (SELECT doc_id, topic, sum(n * ln(p + 1e-12)) AS s FROM (SELECT doc_id, word, count(*) AS n FROM tokens GROUP BY doc_id, word) JOIN phi USING (word) GROUP BY doc_id, topic)
SELECT doc_id, topic FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, topic) = 1""")
def label_outliers(spark, sf_dir):
    d = docs(spark, sf_dir)
    return EM.assign_outliers(V.bag(d), phi(d))


@query("SELECT conv_id * 1000 + turn AS id, conv_id * 1000 AS root, turn AS depth, turn < max(turn) OVER (PARTITION BY conv_id) AS has_child FROM conversations")
def thread_depth(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return TH.structure(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent")))


@query("""WITH t AS (SELECT role, conv_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS n FROM conversations)
SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(sum(n) AS BIGINT) AS words FROM t GROUP BY role""")
def speaker_turns(spark, sf_dir):
    return TH.speakers(table(spark, sf_dir, "conversations"))


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, list_transform(regexp_extract_all(coalesce(text, ''), '" + _PATTERN + "'), lambda w: lower(w)) AS w FROM conversations),
g AS (SELECT id, parent, i AS pos, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram FROM (SELECT *, unnest(range(0, len(w) - 2)) AS i FROM t WHERE len(w) >= 3)),
hit AS (SELECT DISTINCT a.id, a.pos FROM g a JOIN g b ON a.parent = b.id AND a.gram = b.gram)
SELECT DISTINCT id AS doc_id, CAST(pos + d AS INTEGER) AS pos FROM hit, (SELECT unnest([0, 1, 2]) AS d)""".replace('" + _PATTERN + "', _PATTERN))
def copied_runs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"), "text")
    return TH.copied_positions(V.corpus(c), c, 3)


@query(f"""WITH {CORPUS}, b AS (SELECT t, ntile(5) OVER (ORDER BY t) AS block FROM (SELECT DISTINCT doc_id // 10 AS t FROM d)), x AS (SELECT doc_id, block FROM d JOIN b ON d.doc_id // 10 = b.t)
SELECT CAST(f AS INTEGER) AS fold, doc_id, CASE WHEN block = f + 1 THEN 'test' ELSE 'train' END AS role FROM x, (SELECT unnest([1, 2, 3, 4]) AS f) WHERE block <= f + 1""")
def cv_folds_temporal(spark, sf_dir):
    return CV.temporal(docs(spark, sf_dir).withColumn("t", F.expr("doc_id div 10")), "t", 4)


@query(f"""WITH {CORPUS}, g AS (SELECT source, count(*) AS n FROM d GROUP BY source), r AS (SELECT source, row_number() OVER (ORDER BY n DESC, source) - 1 AS i FROM g),
f AS (SELECT source, CAST(CASE WHEN (i // 5) % 2 = 1 THEN 4 - i % 5 ELSE i % 5 END AS INTEGER) AS fold FROM r) SELECT doc_id, fold FROM d JOIN f USING (source)""")
def cv_folds_grouped(spark, sf_dir):
    return CV.balanced_groups(docs(spark, sf_dir), "source", 5)
