"""Fits of the structured, embedded, encoded and positional models over the documents table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import models as M
from ..models.embedded import by_word
from ..models.neural import USABLE
from ..operators import density as D
from .base import _PATTERN, CORPUS, docs, query, table
from .model_queries import _KEPT, LIMITS, SEEDS, _corpus, _features, _fitted, _sound, _sound_sql, _thread, _word_vectors


@query(_sound_sql("4"))
def dtm_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.DTM(4, 3, chain_variance=0.05, iters=40), _corpus(spark, sf_dir, {"slice": F.pmod(F.col("doc_id"), F.lit(3)).cast("int")}, ("slice",)))


@query(_sound_sql("4"))
def sage_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.SAGE(4, 2, iters=40), _corpus(spark, sf_dir, {"grp": F.coalesce(F.col("lang") == "en", F.lit(False)).cast("int")}, ("grp",)), purity=0.0)  # the groups are languages


@query(_sound_sql("6"))
def pachinko_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.PA(3, 6, iters=40), _corpus(spark, sf_dir))


@query(_sound_sql("7"))
def hlda_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.HLDA(depth=3, branching=2, iters=40), _corpus(spark, sf_dir), purity=0.0)  # topics of upper levels are shared


@query(_sound_sql("5"))
def pseudo_document_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.PT(5, pseudo=40, iters=40), _corpus(spark, sf_dir))


@query(_sound_sql("5"))
def rtm_fit(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    links = _thread(c).where("parent is not null").select(F.col("parent").alias("src"), F.col("doc_id").alias("dst"))
    return _fitted(spark, sf_dir, M.RTM(5, iters=40), c, links)


@query(f"""WITH {CORPUS}, {_KEPT} SELECT (SELECT count(*) FROM kept) AS words, count(DISTINCT doc_id) * 4 AS chances, true AS in_bounds, true AS gains, true AS improves
FROM tokens WHERE word IN (SELECT word FROM kept)""")
def corex_fit(spark, sf_dir):
    """Chances lie between 0 and 1, and no word tells a negative amount about a topic."""
    m = M.CorEx(4, anchors=[v[:1] for v in SEEDS.values()], iters=12).fit(_corpus(spark, sf_dir))
    h = [x for _, x in m.fit_history]
    return m.doc_topic.agg(F.count("*").alias("chances"), F.min(F.col("p").between(0, 1)).alias("in_bounds")).select(
        F.lit(len(m.words)).cast("long").alias("words"), "chances", "in_bounds", F.lit(bool((m.mis >= 0).all())).alias("gains"), F.lit(bool(h[-1] > h[0])).alias("improves"))


@query(_sound_sql("4"))
def factorial_lda_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.FactorialLDA((2, 2), iters=40), _corpus(spark, sf_dir))


_CHUNKS = CORPUS.replace("d AS (SELECT * FROM docs WHERE len(toks) > 0)", """d AS (SELECT doc_id || ':' || c AS doc_id, lang, source, toks[c * 50 + 1 : c * 50 + 50] AS toks
  FROM (SELECT *, unnest(range(0, CAST(ceil(len(toks) / 50.0) AS BIGINT))) AS c FROM docs WHERE len(toks) > 0))""")


@query(_sound_sql("4", ctes=_CHUNKS))
def narrative_fit(spark, sf_dir):
    m = M.NarrativeTM(4, degree=2, chunk=50, iters=12)
    return _fitted(spark, sf_dir, m, M.Corpus(m.chunks(docs(spark, sf_dir).select("doc_id", "tokens")), carry=("features",), **LIMITS), purity=0.0)  # chunks are short


@query(_sound_sql("4"))
def etm_fit(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return _fitted(spark, sf_dir, M.ETM(4, by_word(_word_vectors(spark, sf_dir, c)), iters=40), c, gain=None, purity=0.0)  # the table's vectors hardly tell words apart


@query(_sound_sql("4"))
def detm_fit(spark, sf_dir):
    c = _corpus(spark, sf_dir, {"slice": F.pmod(F.col("doc_id"), F.lit(2)).cast("int")}, ("slice",))
    return _fitted(spark, sf_dir, M.DETM(4, 2, by_word(_word_vectors(spark, sf_dir, c)), iters=40), c, gain=None, purity=0.0)  # the table's vectors hardly tell words apart


@query(_sound_sql("4"))
def gaussian_lda_fit(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return _fitted(spark, sf_dir, M.GaussianLDA(4, by_word(_word_vectors(spark, sf_dir, c)), iters=20), c, up=None, gain=0.0, purity=0.0)  # densities of vectors, not of words


@query(_sound_sql("5"))
def prodlda_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.ProdLDA(5, hidden=32, rounds=25, batch=20, lr=0.02), _corpus(spark, sf_dir), product=True, gain=None, purity=0.0)


_WITH_VECTORS = """(SELECT count(DISTINCT doc_id) FROM tokens WHERE word IN (SELECT word FROM kept) AND doc_id IN (SELECT vec_id FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))"""


def _document_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@query(_sound_sql("5", docs=_WITH_VECTORS))
def combined_tm_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.CombinedTM(5, hidden=32, rounds=25, batch=20, lr=0.02), _corpus(spark, sf_dir), _document_vectors(spark, sf_dir), product=True, gain=None, purity=0.0)


@query(_sound_sql("5", docs=_WITH_VECTORS))
def zero_shot_tm_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.ZeroShotTM(5, hidden=32, rounds=25, batch=20, lr=0.02), _corpus(spark, sf_dir), _document_vectors(spark, sf_dir), product=True, gain=None, purity=0.0)


@query(_sound_sql("5"))
def scholar_fit(spark, sf_dir):
    m = M.Scholar(5, hidden=32, rounds=25, batch=20, lr=0.02, n_features=1, n_classes=2)
    d = docs(spark, sf_dir).withColumns(_features()).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id", "left")
    return _fitted(spark, sf_dir, m, M.Corpus(d, carry=m.carry, **LIMITS), product=True, gain=None, purity=0.0)


@query(_sound_sql("4", docs="(SELECT count(DISTINCT doc_id) FROM tokens JOIN kept USING (word) WHERE source IS NOT NULL)"))
def tbip_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.TBIP(4, iters=20), _corpus(spark, sf_dir, {"author": F.col("source")}, ("author",)))


@query("""SELECT count(*) AS vectors, 7 AS authors, 0.0 AS mean, 1.0 AS sd, true AS sums, true AS improves FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0""")
def sentence_ideal_points_fit(spark, sf_dir):
    e = _document_vectors(spark, sf_dir).where(USABLE).withColumn("author", F.concat(F.lit("a"), F.pmod(F.col("doc_id"), F.lit(7)).cast("string")))
    m = M.IdealPointSentenceTM(5, iters=10).fit(e)
    x = np.array(list(m.positions().values()))
    t = m.doc_topic.groupBy("doc_id").agg(F.sum("p").alias("s")).agg(F.count("*").alias("vectors"), F.min(F.abs(F.col("s") - 1) < 1e-6).alias("sums"))
    return t.select("vectors", F.lit(len(x)).alias("authors"), F.lit(round(abs(float(x.mean())), 6)).alias("mean"), F.lit(round(float(x.std()), 6)).alias("sd"), "sums",
                    F.lit(bool(m.fit_history[-1][1] >= m.fit_history[0][1])).alias("improves"))


@query(_sound_sql("4"))
def tensor_lda_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.TensorLDA(4), _corpus(spark, sf_dir))


@query(_sound_sql("5"))
def lda_collapsed_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.LDA(5, iters=10, inference="cvb0"), _corpus(spark, sf_dir))


@query(_sound_sql("4"))
def tree_field_fit(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return _fitted(spark, sf_dir, M.TreeFieldTM(4, rounds=2, iters=30), c, _thread(c))


@query(_sound_sql("7", valued=False, docs="(SELECT count(DISTINCT doc_id) FROM sent WHERE word IN (SELECT word FROM kept))", ctes=CORPUS + """,
sent AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(s, '""" + _PATTERN + """'), lambda t: lower(t))) AS word
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]+|\\S[^\\n]*$')) AS s FROM documents))"""))
def multi_grain_fit(spark, sf_dir):
    return _sound(M.MGLDA(4, 3, iters=15).fit(table(spark, sf_dir, "documents").select("doc_id", "text"), _corpus(spark, sf_dir)))


@query("SELECT count(*) AS vectors, true AS numbered FROM embeddings")
def density_clusters(spark, sf_dir):
    """Every vector is in one cluster or noise, and clusters are numbered without gaps."""
    c = D.density_clusters(_document_vectors(spark, sf_dir), 10, 5)
    n = c.agg(F.count("*").alias("vectors"), F.count_distinct(F.when(F.col("topic") >= 0, F.col("topic"))).alias("k"), F.max("topic").alias("last"), F.min("topic").alias("first"))
    return n.select("vectors", ((F.col("last") < 0) | (F.col("k") == F.col("last") + 1)).alias("numbered"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, greatest(1 - list_cosine_similarity(a.v, b.v), 0) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
c AS (SELECT a, max(d) AS core FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM p) WHERE k <= 5 GROUP BY a)
SELECT p.a AS vec_id, round(min(greatest(d, x.core, y.core)), 6) AS least FROM p JOIN c x ON x.a = p.a JOIN c y ON y.a = p.b GROUP BY p.a""")
def spanning_tree_edges(spark, sf_dir):
    """A minimum spanning tree holds each vector's least edge: of all mutual-reachability distances from it, the smallest."""
    t = D.spanning_tree(_document_vectors(spark, sf_dir), 5)
    ends = t.select(F.explode(F.array("a", "b")).alias("vec_id"), "w")
    return ends.groupBy("vec_id").agg(F.round(F.min("w"), 6).alias("least"))
