"""Queries on intake, selection, naming and judging of topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import models as M
from ..functions import text as T
from ..operators import cooccurrence as C
from ..operators import crossval as CV
from ..operators import documents as D
from ..operators import embedding as EM
from ..operators import selection as S
from ..operators import topics as TP
from ..operators import vocabulary as V
from ..operators import weights as W
from .base import CORPUS, TOPICS, docs, phi, query, r6, table, theta, top_words

_T = f"WITH {CORPUS}, {TOPICS}"


@query(f"WITH {CORPUS}, n AS (SELECT count(*) AS n FROM d) SELECT word, cf, df FROM vocab, n WHERE df > ceil(0.05 * n) ORDER BY df DESC, word LIMIT 8")
def dropped_terms(spark, sf_dir):
    d = docs(spark, sf_dir)
    return V.dropped_terms(V.vocabulary(d), d.count(), 0.05)


@query(f"""WITH {CORPUS}, k AS (SELECT * FROM (VALUES ('a', 'the'), ('a', 'zzzz'), ('b', 'und'), ('b', 'les')) AS t(topic, word))
SELECT topic, word, coalesce(cf, 0) AS cf, coalesce(df, 0) AS df FROM k LEFT JOIN vocab USING (word) WHERE coalesce(cf, 0) >= 5 AND coalesce(df, 0) >= 2""")
def keywords_refined(spark, sf_dir):
    k = spark.createDataFrame([("a", "the"), ("a", "zzzz"), ("b", "und"), ("b", "les")], "topic string, word string")
    return V.refine_keywords(k, V.vocabulary(docs(spark, sf_dir)), 5, 2)


@query(f"""WITH {CORPUS}, a AS (SELECT word, count(*) AS cf FROM tokens WHERE lang = 'en' GROUP BY word), b AS (SELECT word, count(*) AS cf FROM tokens WHERE lang = 'de' GROUP BY word)
SELECT word, coalesce(a.cf, 0) AS cf_a, coalesce(b.cf, 0) AS cf_b FROM a FULL JOIN b USING (word)""")
def vocabularies_merged(spark, sf_dir):
    d = docs(spark, sf_dir)
    return V.merge_vocabularies(V.vocabulary(d.where("lang = 'en'")), V.vocabulary(d.where("lang = 'de'")))


@query(f"WITH {CORPUS} SELECT word, round(ln(n / df), 6) AS idf FROM vocab, nd")
def idf_weights(spark, sf_dir):
    d = docs(spark, sf_dir)
    return W.idf(V.vocabulary(d), d.count()).select("word", r6("idf").alias("idf"))


@query(f"""WITH {CORPUS}, kept AS (SELECT word FROM vocab WHERE df > 3 AND df < 200)
SELECT doc_id, lang, source, count(*) AS n, md5(string_agg(word, ' ' ORDER BY pos)) AS tokens_md5 FROM tokens WHERE word IN (SELECT word FROM kept) GROUP BY doc_id, lang, source""")
def documents_prepared(spark, sf_dir):
    """Words between two document counts; metadata stay beside their documents."""
    d, _, _ = V.keep_words(docs(spark, sf_dir), lower=3, upper=200)
    return d.select("doc_id", "lang", "source", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query("SELECT doc_id, len(list_filter(string_split(lower(coalesce(text, '')), ' '), lambda x: x <> '')) AS n FROM documents WHERE n > 0")
def own_tokenizer(spark, sf_dir):
    d = V.corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer=lambda t: [w for w in t.lower().split(" ") if w])
    return d.select("doc_id", F.size("tokens").cast("long").alias("n"))


@query(f"WITH {CORPUS} SELECT doc_id, md5(string_agg(word || '_' || word, ' ' ORDER BY pos)) AS pairs_md5 FROM tokens WHERE pos < 5 GROUP BY doc_id")
def phrases_joined(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(F.transform(F.slice("tokens", 1, 5), lambda w: T.join_phrase(w, w)), " ")).alias("pairs_md5"))


@query(_T + """, q AS (SELECT doc_id AS query, topic, sqrt(p) AS b FROM theta WHERE doc_id % 100 = 1),
s AS (SELECT query, t.doc_id, round(sqrt(greatest(1 - sum(sqrt(t.p) * b), 0)), 9) AS distance FROM theta t JOIN q USING (topic) WHERE t.doc_id <> query GROUP BY ALL)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, doc_id) AS INTEGER) AS rank, round(distance, 6) AS distance FROM s QUALIFY rank <= 5""")
def nearest_documents(spark, sf_dir):
    """Equal mixtures are frequent here, so ranks and distances are compared, not which of equals come first."""
    t = theta(docs(spark, sf_dir))
    return TP.nearest_documents(t, t.where("doc_id % 100 = 1").select("doc_id").distinct(), 5).select("query", "rank", r6("distance").alias("distance"))


_CENTRE = """c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL) GROUP BY label, i)"""


@query(f"""WITH {_CENTRE}, n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY label)
SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m) / any_value(x.n * y.n), 6) AS cosine FROM c a JOIN c b ON a.i = b.i AND a.label < b.label JOIN n x ON x.label = a.label JOIN n y ON y.label = b.label
GROUP BY a.label, b.label HAVING sum(a.m * b.m) / any_value(x.n * y.n) > 0.05""")
def similar_clusters(spark, sf_dir):
    c = EM.centroids(table(spark, sf_dir, "embeddings").where("embedding is not null"), "label")
    return EM.similar_topics(c, "label", 0.05).select("a", "b", r6("cosine").alias("cosine"))


@query(_T + """, few AS (SELECT DISTINCT word FROM top), w AS (SELECT word, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (
  SELECT word, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM (SELECT DISTINCT doc_id, word FROM tokens WHERE word IN (SELECT word FROM few)) JOIN embeddings ON vec_id = doc_id WHERE embedding IS NOT NULL) GROUP BY word, i),
n AS (SELECT word, sqrt(sum(m * m)) AS n FROM w GROUP BY word),
cs AS (SELECT x.topic, x.word AS wx, y.word AS wy, sum(a.m * b.m) / any_value(na.n * nb.n) AS c FROM top x JOIN top y ON x.topic = y.topic AND x.rank > y.rank
  JOIN w a ON a.word = x.word JOIN w b ON b.word = y.word AND a.i = b.i JOIN n na ON na.word = x.word JOIN n nb ON nb.word = y.word GROUP BY x.topic, x.word, y.word)
SELECT topic, round(avg(c), 6) AS score FROM cs GROUP BY topic""")
def coherence_embedding(spark, sf_dir):
    d = docs(spark, sf_dir)
    top = top_words(d)
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("doc_id"), "embedding")
    words = d.select("doc_id", F.explode(F.array_distinct("tokens")).alias("word")).join(F.broadcast(top.select("word").distinct()), "word")
    vectors = EM.centroids(words.join(e, "doc_id"), "word").select("word", F.col("centroid").alias("embedding"))
    return C.embedding_coherence(top, vectors).select("topic", r6("score").alias("score"))


@query(_T + """, few AS (SELECT topic, word, row_number() OVER (PARTITION BY topic ORDER BY p DESC, word) AS rank FROM phi QUALIFY rank <= 10),
s AS (SELECT f.topic, p.word, p.p FROM (SELECT DISTINCT topic FROM few) f JOIN phi p ON p.topic = f.topic WHERE p.word IN (SELECT word FROM few) AND p.word NOT IN (SELECT word FROM few x WHERE x.topic = f.topic)),
i AS (SELECT topic, arg_min(word, (p, word)) AS intruder FROM s GROUP BY topic)
SELECT topic, intruder, CAST(6 AS INTEGER) AS shown, true AS found FROM i""")
def word_intrusion(spark, sf_dir):
    """The judge here knows the answers, as a function stands for the language model."""
    x = S.intruders(phi(docs(spark, sf_dir)), 5)
    strange = {r["intruder"] for r in x.select("intruder").collect()}
    judge = S.intrusion_score(x, lambda prompt: next(w for w in prompt.split("\n", 1)[1].split(", ") if w in strange))
    return x.join(judge, "topic").select("topic", "intruder", F.size("words").alias("shown"), "found")


@query(_T + " SELECT topic, string_agg(word, ' ' ORDER BY rank) FILTER (rank <= 3) AS label FROM top GROUP BY topic")
def topics_named(spark, sf_dir):
    """The function that stands for the language model answers with the first three words."""
    return S.label_with(top_words(docs(spark, sf_dir)), lambda prompt: " ".join(prompt.split("Words: ")[1].split(", ")[:3]))


@query(f"""WITH v AS (SELECT coalesce(lang, '?') AS v, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT unnest(range(0, 5)) AS fold)
SELECT v AS lang, CAST(fold AS INTEGER) AS fold, n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS n FROM v, k WHERE n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END > 0""")
def cv_folds_stratified(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.join(CV.stratified(d, "lang"), "doc_id").groupBy(F.coalesce("lang", F.lit("?")).alias("lang"), "fold").agg(F.count("*").alias("n"))


@query("SELECT CAST(unnest([3, 5]) AS INTEGER) AS k, true AS heldout, true AS exclusive, true AS coherent")
def search_k(spark, sf_dir):
    """Numbers of topics against held-out tokens, coherence and exclusivity."""
    make = lambda k, d: M.LDA(k, iters=10).fit(M.Corpus(d, min_df=5, max_df=0.5))
    t = S.search_k(docs(spark, sf_dir).select("doc_id", "tokens"), [3, 5], make)
    return t.select("k", (F.col("heldout") < 0).alias("heldout"), F.col("exclusivity").between(0, 10).alias("exclusive"), (F.col("coherence") < 1000).alias("coherent"))


@query("SELECT count(DISTINCT label) - 2 AS topics, count(*) AS rows FROM embeddings WHERE label IS NOT NULL AND label >= 0 AND embedding IS NOT NULL")
def topics_reduced(spark, sf_dir):
    """Two topics fewer: the smallest join their nearest, one after the other."""
    e = table(spark, sf_dir, "embeddings").where("label >= 0 and embedding is not null")
    n = e.select("label").distinct().count()
    c = EM.centroids(e, "label").withColumnRenamed("label", "topic")
    groups = S.reduce_topics(c.select("topic", "centroid"), c.select("topic", "n"), n - 2)
    m = TP.merge_labels(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic")), groups)
    return m.agg(F.countDistinct("topic").alias("topics"), F.count("*").alias("rows"))


@query("""WITH s AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents) SELECT lang, count(*) AS docs FROM s GROUP BY lang""")
def sentence_chunks_keep_metadata(spark, sf_dir):
    c = D.chunk_sentences(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), 100)
    return c.where("chunk = 0").groupBy("lang").agg(F.count("*").alias("docs"))
