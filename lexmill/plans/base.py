"""How queries are registered, and the corpus tables that they share with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, spread
from ..functions.text import TOKEN
from ..operators import topics as TP
from ..operators import vocabulary as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_PATTERN = TOKEN.replace("'", "''")
#: CTEs: documents as token lists, those with tokens, one row a token, the vocabulary.
CORPUS = f"""docs AS (SELECT doc_id, lang, source, list_transform(regexp_extract_all(coalesce(text, ''), '{_PATTERN}'), lambda t: lower(t)) AS toks FROM documents),
d AS (SELECT * FROM docs WHERE len(toks) > 0),
tokens AS (SELECT doc_id, lang, source, unnest(toks) AS word, generate_subscripts(toks, 1) - 1 AS pos FROM d),
vocab AS (SELECT word, count(*) AS cf, count(DISTINCT doc_id) AS df FROM tokens GROUP BY word),
nd AS (SELECT count(*) AS n FROM d)"""
#: CTEs: languages as topics (phi), and each document's mixture by its words' leading language (theta).
TOPICS = """ltok AS (SELECT lang, word, count(*) AS n FROM tokens WHERE lang IS NOT NULL GROUP BY lang, word),
ltot AS (SELECT lang, sum(n) AS total FROM ltok GROUP BY lang), vs AS (SELECT count(DISTINCT word) AS v FROM ltok),
phi AS (SELECT t.lang AS topic, w.word, (coalesce(n.n, 0) + 0.01) / (t.total + 0.01 * vs.v) AS p
  FROM (SELECT DISTINCT word FROM ltok) w CROSS JOIN ltot t CROSS JOIN vs LEFT JOIN ltok n ON n.lang = t.lang AND n.word = w.word),
lead_lang AS (SELECT word, lang AS topic FROM ltok QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, lang) = 1),
nt AS (SELECT doc_id, topic, count(*) AS n FROM tokens JOIN lead_lang USING (word) GROUP BY doc_id, topic),
nl AS (SELECT doc_id, sum(n) AS total FROM nt GROUP BY doc_id), ks AS (SELECT count(DISTINCT topic) AS k FROM lead_lang),
theta AS (SELECT l.doc_id, k.topic, (coalesce(nt.n, 0) + 0.1) / (l.total + 0.1 * ks.k) AS p
  FROM nl l CROSS JOIN (SELECT DISTINCT topic FROM lead_lang) k CROSS JOIN ks LEFT JOIN nt ON nt.doc_id = l.doc_id AND nt.topic = k.topic),
top AS (SELECT lang AS topic, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM ltok QUALIFY rank <= 10)"""


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame by its name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, tokens) of the documents that have tokens."""
    return V.corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")))


def r6(c):
    return F.round(c, 6)


def lang_counts(d: DataFrame) -> DataFrame:
    return d.where("lang is not null").select("lang", F.explode("tokens").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


def top_words(d: DataFrame, n: int = 10) -> DataFrame:
    """(topic, word, rank): the leading words of each language."""
    return V.top_words(lang_counts(d).withColumnRenamed("lang", "topic"), "topic", "n", n).select("topic", "word", "rank")


def phi(d: DataFrame) -> DataFrame:
    return TP.phi_from(d.where("lang is not null").select(F.col("lang").alias("topic"), F.explode("tokens").alias("word")))


#: Rows of a table of words that is sent to all tasks.
SENT = 250_000


def theta(d: DataFrame) -> DataFrame:
    """Mixtures by the leading language of each token's word.

    A word of one language leads to its document's own, so tokens only meet the words that several languages share; those
    of documents without a language meet all words.
    """
    lead = cut(lang_counts(d).groupBy("word").agg(F.min_by("lang", F.struct((-F.col("n")).alias("a"), "lang")).alias("topic"), F.count("*").alias("langs")))
    shared = lead.where("langs > 1").select("word", "topic")
    if shared.count() <= SENT:
        shared = F.broadcast(shared)
    words = d.select("doc_id", "lang", F.explode("tokens").alias("word"))
    own = words.where("lang is not null").join(shared, "word", "left").select("doc_id", F.coalesce("topic", "lang").alias("topic"))
    other = words.where("lang is null").join(lead, "word").select("doc_id", "topic")
    return TP.theta_from(own.unionByName(other), lead)


def bag(d: DataFrame) -> DataFrame:
    """(doc_id, word, n), dealt by documents."""
    return V.bag(d.select("doc_id", "tokens").repartition("doc_id"))
