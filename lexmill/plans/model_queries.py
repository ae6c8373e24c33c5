"""Fits over the documents table, run until they settle.

A fit's tables can't be had from SQL, but what must hold of them can: how many documents and words take part, that
mixtures and topics sum to 1, and that the fit's own measure got better. The tests hold fits against planted corpora.
"""

from __future__ import annotations

import copy
import logging

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import models as M
from ..functions import text as T
from ..functions.lineage import cut
from ..models.base import numbered
from ..models.embedded import by_word, mean_vectors
from ..models.neural import USABLE
from ..operators import documents as D
from ..operators import vocabulary as V
from .base import CORPUS, docs, query, table

log = logging.getLogger(__name__).info
LIMITS = {"min_df": 5, "max_df": 0.5}
_KEPT = "kept AS (SELECT word FROM vocab, nd WHERE df >= 5 AND df <= ceil(0.5 * n))"


def _sound_sql(topics: str, phi: str = "1.0", ctes: str = CORPUS, kept: str = _KEPT, docs: str | None = None, valued: bool = True) -> str:
    docs = docs or "(SELECT count(DISTINCT doc_id) FROM tokens WHERE word IN (SELECT word FROM kept))"
    values = """, (SELECT count(*) FROM tokens JOIN kept USING (word)) AS tokens,
(SELECT round(sum(n * ln(n / t)) / any_value(t), 4) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM tokens JOIN kept USING (word) GROUP BY word)) AS unigram,
true AS gains, true AS parts_languages""" if valued else ""
    return f"""WITH {ctes}, {kept} SELECT CAST({topics} AS INTEGER) AS topics, (SELECT count(*) FROM kept) AS words, {docs} AS docs,
1.0 AS theta_low, 1.0 AS theta_high, {phi} AS phi_low, {phi} AS phi_high, true AS improves{values}"""


def _sound(m, corpus=None, langs=None, up: bool | None = True, gain: float | None = 0.2, purity: float = 0.8, product: bool = False):
    """One row: what must hold of a fit, and how well it explains its corpus.

    Numbers of topics, words and documents, the least and greatest sums of mixtures and of topics, and if the fit's own
    measure got better (up: which way; None where it is no measure of the fit, for which the gain then stands). With the corpus also its tokens and their mean log chance when words are drawn without topics, and
    whether the fit's mixtures and topics raise that by gain at least (None: not asked); with langs, whether the topics part the languages,
    which the fit isn't told: of all topics' mass, the share that lies in the topic's leading language, against purity.
    """
    h, sums = [x for _, x in m.fit_history], np.round(m.topic_word.sum(axis=1), 6)
    t = m.theta.groupBy("doc_id").agg(F.sum("p").alias("s")).agg(F.count("*").alias("docs"), F.round(F.min("s"), 6).alias("theta_low"), F.round(F.max("s"), 6).alias("theta_high"))
    out = {"topics": F.lit(len(sums)), "words": F.lit(len(m.words)).cast("long"), "phi_low": F.lit(float(sums.min())), "phi_high": F.lit(float(sums.max()))}
    if corpus is not None:
        like, n = m.log_likelihood(corpus, product)
        cf = corpus.rows.select(F.inline(F.arrays_zip("i", "n"))).groupBy("i").agg(F.sum("n").alias("n"))
        u = cf.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("x")).first()
        unigram = u["x"] / u["t"] - np.log(u["t"])
        gains = like / n - unigram
        out |= {"tokens": F.lit(int(u["t"])).cast("long"), "unigram": F.lit(round(float(unigram), 4)), "gains": F.lit(bool(gain is None or gains >= gain))}
        log(f"gain {gains:.3f}")
        own = m.theta.join(langs.where("lang is not null").withColumnRenamed("doc_id", "owner"), F.substring_index(m.theta["doc_id"].cast("string"), ":", 1) == F.col("owner").cast("string"))  # chunks are named document:number
        mass = own.groupBy("topic", "lang").agg(F.sum("p").alias("x")).groupBy("topic").agg(F.max("x").alias("lead"), F.sum("x").alias("all")).agg(F.sum("lead") / F.sum("all")).first()[0]
        log(f"purity {mass}")
        out["parts_languages"] = F.lit(bool((mass or 0) >= purity))
    else:
        gains = None
    better = (h[-1] > h[0] if up else h[-1] < h[0]) if len(h) > 1 and up is not None else gains is not None and gains >= (gain or 0.0)
    out["improves"] = F.lit(bool(better))
    log(f"history {h[:1]} {h[-1:]} {len(h)}")
    return t.select("docs", "theta_low", "theta_high", *[v.alias(k) for k, v in out.items()])


def _fitted(spark, sf_dir, model, corpus, *more, owner=None, **bounds):
    """_sound() of the model fitted to the corpus; owner is the column of a list whose one entry a mixture belongs to."""
    m = model.fit(corpus, *more)
    if owner:
        corpus = copy.copy(corpus)
        corpus.rows = corpus.rows.withColumn("doc_id", F.col(owner)[0])
    return _sound(m, corpus, table(spark, sf_dir, "documents").select("doc_id", "lang"), **bounds)


def _corpus(spark, sf_dir, columns=None, carry=()):
    d = docs(spark, sf_dir)
    return M.Corpus(d.withColumns(columns) if columns else d, carry=carry, **LIMITS)


SEEDS = {"english": ["the", "and", "of"], "german": ["der", "und", "die"], "french": ["le", "et", "que"], "spanish": ["el", "los", "una"]}


def _features():
    return {"features": F.array(F.coalesce(F.col("lang") == "en", F.lit(False)).cast("double"))}


@query(_sound_sql("20"))
def lda_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.LDA(20), _corpus(spark, sf_dir))


@query(_sound_sql("10"))
def lda_priors_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.LDA(10, learn_alpha=True, learn_beta=True, iters=20), _corpus(spark, sf_dir))


@query(_sound_sql("10"))
def online_lda_fit(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    m = M.OnlineLDA(10, iters=60, batches=3, tau=1.0).fit(c)
    m.fit_history = m.fit_history[::3]  # bounds of the same batch
    return _sound(m, c, table(spark, sf_dir, "documents").select("doc_id", "lang"))


@query(_sound_sql("6"))
def seeded_lda_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.SeededLDA(SEEDS, residual=2), _corpus(spark, sf_dir))


@query(_sound_sql("(SELECT count(DISTINCT lang) FROM tokens JOIN kept USING (word) WHERE lang IS NOT NULL)"))
def labeled_lda_fit(spark, sf_dir):
    c = _corpus(spark, sf_dir, {"labels": F.array_compact(F.array("lang"))}, ("labels",))
    langs = sorted(r["x"] for r in c.rows.select(F.explode("labels").alias("x")).distinct().collect())
    return _fitted(spark, sf_dir, M.LabeledLDA(langs), c)


@query(_sound_sql("6"))
def keyatm_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.KeyATM(SEEDS, regular=2), _corpus(spark, sf_dir))


@query(_sound_sql("6"))
def dmr_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.DMR(6, 1, iters=30), _corpus(spark, sf_dir, _features(), ("features",)))


@query(_sound_sql("6"))
def gdmr_fit(spark, sf_dir):
    m = M.GDMR(6, {"x": (0.0, 100.0)}, iters=30)
    d = m.basis(docs(spark, sf_dir).withColumn("x", F.pmod(F.col("doc_id"), F.lit(101)).cast("double")))
    return _fitted(spark, sf_dir, m, M.Corpus(d, carry=("features",), **LIMITS))


@query(_sound_sql("10"))
def stm_fit(spark, sf_dir):
    m = M.STM(10, n_features=1)
    return _fitted(spark, sf_dir, m, _corpus(spark, sf_dir, _features(), m.carry))


@query(_sound_sql("6"))
def ctm_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.CTM(6), _corpus(spark, sf_dir))


@query(_sound_sql("12"))
def hdp_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.HDP(12, iters=30), _corpus(spark, sf_dir))


_LANG = CORPUS.replace("unnest(toks) AS word", "lang || ':' || unnest(toks) AS word").replace("d AS (SELECT * FROM docs WHERE len(toks) > 0)", "d AS (SELECT * FROM docs WHERE len(toks) > 0 AND lang IS NOT NULL)")


@query(_sound_sql("5", "CAST((SELECT count(DISTINCT split_part(word, ':', 1)) FROM kept) AS DOUBLE)", _LANG))
def polylingual_lda_fit(spark, sf_dir):
    d = docs(spark, sf_dir).where("lang is not null").withColumn("tokens", F.transform("tokens", lambda w: F.concat("lang", F.lit(":"), w)))
    return _fitted(spark, sf_dir, M.PolylingualLDA(5, iters=20), M.Corpus(d, **LIMITS))


@query(_sound_sql("10"))
def nmf_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.NMF(10), _corpus(spark, sf_dir), up=False)


@query(_sound_sql("6"))
def nmf_kl_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.NMF(6, loss="kl", weighting="counts", iters=30), _corpus(spark, sf_dir), up=False)


@query(_sound_sql("5"))
def guided_nmf_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.GuidedNMF(SEEDS, 5, iters=30), _corpus(spark, sf_dir), up=False)


@query("SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS topic, true AS orthonormal, true AS descending, true AS energy")
def lsa_fit(spark, sf_dir):
    """Components are orthonormal, singular values descend, and documents' squared values sum to a value's square."""
    m = M.LSA(10).fit(_corpus(spark, sf_dir))
    gram, sv = m.components @ m.components.T, m.singular_values
    near = F.abs(F.col("e") / F.element_at(F.array(*[F.lit(float(x * x)) for x in sv]), F.col("topic") + 1) - 1) < 0.02
    falls = F.element_at(F.array(*[F.lit(bool(i == 0 or sv[i] <= sv[i - 1])) for i in range(len(sv))]), F.col("topic") + 1)
    e = m.doc_topic.groupBy("topic").agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    return e.select("topic", F.lit(bool(np.abs(gram - np.eye(len(gram))).max() < 1e-6)).alias("orthonormal"), falls.alias("descending"), near.alias("energy"))


@query(_sound_sql("15"))
def gsdmm_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.GSDMM(15, iters=30), _corpus(spark, sf_dir), up=None)  # its history counts clusters


@query(_sound_sql("6", docs="(SELECT count(*) FROM d)"))
def btm_fit(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "tokens")
    c = M.Corpus(d, **LIMITS)
    return _sound(M.BTM(6, window=5, iters=20).fit(d, c), c, table(spark, sf_dir, "documents").select("doc_id", "lang"))


@query(_sound_sql("6"))
def anchor_lda_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.AnchorLDA(6), _corpus(spark, sf_dir))


@query(_sound_sql("8"))
def warp_lda_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.WarpLDA(8, iters=60), _corpus(spark, sf_dir))


@query(f"""WITH {CORPUS}, {_KEPT} SELECT word, count(*) AS n, true AS phi_follows FROM tokens JOIN kept USING (word) GROUP BY word""")
def warp_lda_assignments(spark, sf_dir):
    """Every token has a topic: summed over documents and topics the table holds each word's count; topics follow from it."""
    c = _corpus(spark, sf_dir)
    w = M.WarpLDA(8, iters=10)
    m = w.fit(c)
    words = numbered(spark, c.words)
    counts = w.assignments.groupBy("i", "topic").agg(F.sum("n").alias("n"))
    share = (F.col("n") + w.beta) / (F.sum("n").over(Window.partitionBy("topic")) + w.beta * c.size)
    both = counts.withColumn("share", share).join(F.broadcast(words), "i").join(m.phi(spark), ["topic", "word"])
    return both.groupBy("word").agg(F.sum("n").alias("n"), F.min(F.abs(F.col("share") - F.col("p")) < 1e-9).alias("phi_follows"))


@query(f"""WITH {CORPUS}, {_KEPT}, follow AS (SELECT word AS second, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS first FROM tokens)
SELECT first, second, count(*) AS n, true AS phrases_occur, true AS phrases_found FROM follow WHERE first IN (SELECT word FROM kept) AND second IN (SELECT word FROM kept) GROUP BY first, second HAVING count(*) >= 20""")
def topical_ngrams(spark, sf_dir):
    """Pairs of neighbours that the model may carry on; its two-word phrases are among these, no oftener than they occur."""
    m = M.TopicalNGrams(6, min_pair=20, iters=15)
    d = docs(spark, sf_dir)
    words = F.broadcast(numbered(spark, m.fit(d, **LIMITS).words))
    name = lambda c: words.select(F.col("i").alias(c), F.col("word").alias({"a": "first", "b": "second"}[c]))
    pairs = cut(m.pair_counts.join(name("a"), "a").join(name("b"), "b").select("first", "second", "n"))
    two = m.phrases().where(F.size(F.split("phrase", " ")) == 2).groupBy("phrase").agg(F.sum("n").alias("said"))
    met = two.join(pairs, two["phrase"] == F.concat_ws(" ", "first", "second"), "left").agg(F.min(F.coalesce(F.col("said") <= F.col("n"), F.lit(False))).alias("fits"), F.count("*").alias("k")).first()
    return pairs.select("*", F.lit(bool(met["fits"])).alias("phrases_occur"), F.lit(met["k"] > 0).alias("phrases_found"))


@query(_sound_sql("6"))
def stm_content_fit(spark, sf_dir):
    """Languages as groups that word topics in their own ways, with sparse deviations."""
    langs = sorted(r[0] for r in table(spark, sf_dir, "documents").where("lang is not null").select("lang").distinct().collect())  # a row a language
    m = M.STM(6, groups=[*langs, "?"], content="sparse", interactions=False, iters=15)
    return _fitted(spark, sf_dir, m, _corpus(spark, sf_dir, {"group": F.coalesce("lang", F.lit("?"))}, m.carry), purity=0.0, gain=0.0)


@query(_sound_sql("6", docs="(SELECT count(DISTINCT coalesce(source, '?')) FROM tokens JOIN kept USING (word))"))
def author_topic_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.AuthorTopic(6), _corpus(spark, sf_dir, {"authors": F.array(F.coalesce("source", F.lit("?")))}, ("authors",)), owner="authors", purity=0.0, gain=0.0)


@query(_sound_sql("6", docs="(SELECT count(DISTINCT coalesce(source, '?') || '>' || lang) FROM tokens JOIN kept USING (word) WHERE lang IS NOT NULL)"))
def author_recipient_fit(spark, sf_dir):
    d = M.AuthorRecipientTopic.pairs(docs(spark, sf_dir).withColumns({"author": F.coalesce("source", F.lit("?")), "recipients": F.array_compact(F.array("lang"))}))
    return _fitted(spark, sf_dir, M.AuthorRecipientTopic(6), M.Corpus(d, carry=("authors",), **LIMITS), owner="authors", purity=0.0)


@query(_sound_sql("6"))
def topics_over_time_fit(spark, sf_dir):
    m = M.TopicsOverTime(6, iters=20)
    return _fitted(spark, sf_dir, m, _corpus(spark, sf_dir, {"time": F.pmod(F.col("doc_id"), F.lit(1000)) / 1000.0}, ("time",)))


@query(_sound_sql("6"))
def supervised_lda_fit(spark, sf_dir):
    y = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    return _fitted(spark, sf_dir, M.SupervisedLDA(6, iters=15), M.Corpus(docs(spark, sf_dir).join(y, "doc_id", "left"), carry=("y",), **LIMITS))


@query(_sound_sql("9"))
def disc_lda_fit(spark, sf_dir):
    return _fitted(spark, sf_dir, M.DiscLDA(["en", "de", "fr", "es"], 2, 1, iters=20), _corpus(spark, sf_dir, {"y": F.col("lang")}, ("y",)))


def _thread(c):
    """Documents in runs of five, each answering the one before."""
    return c.rows.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") - 1).alias("parent"))


@query(_sound_sql("6"))
def thread_topics_fit(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return _fitted(spark, sf_dir, M.ThreadTM(M.LDA(6)), c, _thread(c), purity=0.7)


@query(_sound_sql("6"))
def comment_weight_fit(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return _fitted(spark, sf_dir, M.CSATM(M.LDA(6)), c, _thread(c), purity=0.7)


def _usable(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(USABLE).select(F.col("vec_id").alias("doc_id"), "embedding")


def _word_vectors(spark, sf_dir, corpus):
    """(word, embedding): the mean of the document vectors of each word that the fits keep."""
    return mean_vectors(corpus, _usable(spark, sf_dir))


@query(_sound_sql("5", kept="kept AS (SELECT word FROM vocab, nd WHERE df >= 5 AND df <= ceil(0.5 * n))"))
def embedding_lda_fit(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return _fitted(spark, sf_dir, M.EmbeddingLDA(5, by_word(_word_vectors(spark, sf_dir, c)), top_n=5, iters=20), c)


@query("SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS topic, 1.0 AS phi, true AS improves")
def key_nmf_fit(spark, sf_dir):
    c, e = _corpus(spark, sf_dir), _usable(spark, sf_dir)
    w, names = cut(_word_vectors(spark, sf_dir, c)), numbered(spark, c.words)
    words = c.rows.join(e.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode("i").alias("i")).join(F.broadcast(names), "i").select("doc_id", "word")
    m = M.KeyNMF(4, top_n=10, iters=30).fit_embeddings(words, e, w)
    falls = m.fit_history[-1][1] <= m.fit_history[0][1]
    return m.phi(spark).groupBy("topic").agg(F.round(F.sum("p"), 6).alias("phi")).withColumn("improves", F.lit(bool(falls)))


@query("SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS topic, 0.0 AS mean, 1.0 AS variance")
def semantic_signals_fit(spark, sf_dir):
    """Signals are centred and of unit variance, as whitening leaves them."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    s = M.SemanticSignals(5).fit(e).doc_topic.groupBy("topic").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    return s.select("topic", F.round(F.abs("m"), 4).alias("mean"), F.round("v", 4).alias("variance"))


@query("SELECT label AS topic, count(*) AS n FROM embeddings GROUP BY label")
def bertopic_fit(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("topic"))
    return M.BERTopic(10).fit(docs(spark, sf_dir), e.select("doc_id", "embedding"), e.select("doc_id", "topic")).info().select("topic", "n")


@query("SELECT label AS topic, CAST(10 AS BIGINT) AS words FROM embeddings WHERE label IS NOT NULL AND label <> -1 GROUP BY label")
def top2vec_fit(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("topic"))
    w = _word_vectors(spark, sf_dir, _corpus(spark, sf_dir))
    return M.Top2Vec(10).fit(docs(spark, sf_dir), e.select("doc_id", "embedding"), e.select("doc_id", "topic")).nearest_words(w).groupBy("topic").agg(F.count("*").alias("words"))


@query(f"""WITH {CORPUS} SELECT count(DISTINCT source) AS authors, 0.0 AS mean, 1.0 AS sd, true AS improves FROM tokens""")
def wordfish_positions(spark, sf_dir):
    m = M.Wordfish().fit(docs(spark, sf_dir), "source")
    p = m.positions(spark).agg(F.count("*").alias("authors"), F.round(F.abs(F.avg("position")), 6).alias("mean"), F.round(F.stddev_pop("position"), 6).alias("sd"))
    return p.withColumn("improves", F.lit(bool(m.fit_history[-1][1] >= m.fit_history[0][1])))


@query(f"""WITH {CORPUS}, many AS (SELECT lang FROM tokens WHERE lang IS NOT NULL GROUP BY lang HAVING count(DISTINCT source) > 2)
SELECT (SELECT count(*) FROM many) AS domains, count(DISTINCT source) AS speakers, 0.0 AS mean, 1.0 AS sd FROM tokens WHERE lang IN (SELECT lang FROM many)""")
def wordshoal_positions(spark, sf_dir):
    m = M.Wordshoal(iters=50).fit(docs(spark, sf_dir), "source", "lang")
    rows = [(len(m.domains), len(m.speakers), round(abs(float(m.theta.mean())), 6), round(float(m.theta.std()), 6))]
    return spark.createDataFrame(rows, "domains long, speakers long, mean double, sd double")


@query("SELECT CASE WHEN lower(coalesce(text, '')) LIKE '% the %' THEN 'english' ELSE 'other' END AS topic, count(*) AS n FROM documents GROUP BY ALL")
def topic_gpt_assign(spark, sf_dir):
    """A function stands for the language model."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = M.TopicGPT(lambda prompt: "english" if " the " in prompt.split("\n", 2)[-1].lower() else "other")
    m.topics = ["english", "other"]
    return m.assign(d).groupBy("topic").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def events_by_user(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from ..streaming.online import event_windows as windows

    return windows(table(spark, sf_dir, "events")).select("start", "event_type", "n")


@query("""WITH s AS (SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]+|\\S[^\\n]*$'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')) AS n FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS start, CAST(least(n - i, 3) AS INTEGER) AS n FROM (SELECT doc_id, n, unnest(range(0, greatest(n - 3, 0) + 1)) AS i FROM s WHERE n > 0)""")
def mgl_sentence_windows(spark, sf_dir):
    return D.sentence_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), 3).select("doc_id", "start", F.size("sentences").alias("n"))


@query(f"""WITH {CORPUS}, k AS (SELECT doc_id, len(toks) AS n, CAST(ceil(len(toks) / 50.0) AS BIGINT) AS k FROM d)
SELECT doc_id, CAST(i AS INTEGER) AS segment, CASE WHEN k = 1 THEN 0.5 ELSE i / (k - 1) END AS position, CAST(least(n - i * 50, 50) AS INTEGER) AS n FROM (SELECT *, unnest(range(0, k)) AS i FROM k)""")
def narrative_segments(spark, sf_dir):
    return D.segments(docs(spark, sf_dir), 50).select("doc_id", "segment", "position", F.size("tokens").alias("n"))


@query("""WITH p AS (SELECT page_id, regexp_split_to_array(regexp_replace(html, '(?s)<i>.*?</i>', ' ', 'g'), '<p>|\\n') AS p FROM pages),
q AS (SELECT page_id, array_to_string(list_filter(list_transform(p, lambda x: trim(x, ' ')), lambda x: NOT regexp_matches(x, '^(>|&gt;)') AND x <> ''), ' ') AS t FROM p)
SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&#x2F;', '/'), '&nbsp;', ' '), '&amp;', '&')) AS text_md5 FROM q""")
def quotes_stripped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_quotes(F.col("html"))).alias("text_md5"))


_PAGES = CORPUS.replace("doc_id, lang, source, list_transform", "page_id AS doc_id, NULL AS lang, NULL AS source, list_transform").replace("coalesce(text, '')", "coalesce(html, '')").replace("FROM documents", "FROM pages")


@query(f"WITH {_PAGES} SELECT word, cf, df FROM vocab WHERE word IN ('http', 'https', 'www', 'href', 'aspx', 'html', 'nbsp')")
def web_leak_words(spark, sf_dir):
    p = V.corpus(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))
    return V.web_leak(V.vocabulary(p))
