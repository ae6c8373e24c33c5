"""Corpus tables, vocabularies and the filters on them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def corpus(df: DataFrame, text_col: str = "text", keep_empty: bool = False, tokenizer: Callable[[str], Iterable[str]] | None = None, **how) -> DataFrame:
    """df with its text tokenised into column tokens; documents without tokens are dropped unless kept.

    A tokenizer of the caller's own takes the place of the built-in one: a function of a text (null: empty), which runs
    over Arrow batches; lowercase, stopwords and min_length are then its own business.

    The one-element explode keeps the optimiser from copying the tokeniser into later expressions, where a lambda
    would run it for every element.
    """
    if tokenizer is not None:
        if how:
            raise ValueError(f"a tokenizer of one's own takes no {', '.join(how)}")
        tokens = F.pandas_udf(lambda x: x.map(lambda t: [str(w) for w in tokenizer(t or "")]), "array<string>")(F.col(text_col))
    else:
        tokens = T.tokenize(F.col(text_col), **how)
    out = df.select(*[c for c in df.columns if c not in (text_col, "tokens")], F.explode(F.array(tokens)).alias("tokens"))
    return out if keep_empty else out.where(F.size("tokens") > 0)


def long_tokens(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, carry..., pos, word)."""
    return docs.select("doc_id", *carry, F.posexplode("tokens").alias("pos", "word"))


def bag(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, carry..., word, n)."""
    return long_tokens(docs, *carry).groupBy("doc_id", *carry, "word").agg(F.count("*").alias("n"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, cf, df) in one shuffle: each document sends its words and, once each, its distinct words."""
    t = docs.select(F.size("tokens").alias("n"), F.posexplode(F.concat("tokens", F.array_distinct("tokens"))).alias("pos", "word"))
    return t.groupBy("word").agg(F.count(F.when(F.col("pos") < F.col("n"), 1)).alias("cf"), F.count(F.when(F.col("pos") >= F.col("n"), 1)).alias("df"))


def prune(vocab: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, min_cf: int = 0, rm_top: int = 0, max_features: int | None = None) -> DataFrame:
    """Words that stay: the rm_top most frequent go first, then document and corpus counts decide, then the most frequent stay.

    n_docs counts the documents with tokens; max_df is a share of them, rounded up. Ties of frequency go to the smaller word.
    """
    if rm_top:
        vocab = vocab.join(F.broadcast(vocab.orderBy(F.desc("cf"), "word").limit(rm_top).select("word")), "word", "left_anti")
    out = vocab.where((F.col("df") >= min_df) & (F.col("df") <= F.ceil(F.lit(float(n_docs)) * F.lit(float(max_df)))) & (F.col("cf") >= min_cf))
    return out.orderBy(F.desc("cf"), "word").limit(max_features) if max_features else out


def document_limits(n_docs: int, min_df: float = 1, max_df: float = 1.0) -> tuple[int, float]:
    """Aliases that count documents (int) or share them (float) as (least count, greatest share)."""
    least = max(1, -int(-min_df * n_docs // 1)) if isinstance(min_df, float) else min_df
    most = max_df if isinstance(max_df, float) else min(1.0, max_df / max(n_docs, 1))
    return least, most


def keep_words(docs: DataFrame, lower: int | None = None, upper: int | None = None, **bounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, words, emptied): documents less the words that are pruned, the words that stay, and ids of documents that lose all.

    lower and upper bound the number of documents that a word lies in (above the one, below the other); bounds are those
    of prune(). All other columns stay beside their documents. Asking for a bound in both forms is an error.
    """
    if (lower is not None and "min_df" in bounds) or (upper is not None and "max_df" in bounds):
        raise ValueError("lower and min_df, or upper and max_df, are two forms of one bound")
    vocab = vocabulary(docs)
    n = docs.count() if bounds else 0
    kept = prune(vocab, n, **bounds) if bounds else vocab
    if lower is not None:
        kept = kept.where(F.col("df") > lower)
    if upper is not None:
        kept = kept.where(F.col("df") < upper)
    words = kept.select("word")
    at = docs.select("doc_id", F.posexplode("tokens").alias("pos", "word")).join(words, "word", "left_semi")
    left = at.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]).alias("stay"))
    both = docs.join(left, "doc_id", "left")
    out = both.where("stay is not null").select(*[F.col("stay").alias(c) if c == "tokens" else F.col(c) for c in docs.columns])
    return out, kept, both.where("stay is null").select("doc_id")


def dropped_terms(vocab: DataFrame, n_docs: int, max_df: float, show: int = 8) -> DataFrame:
    """The first words that max_df takes away."""
    return vocab.where(F.col("df") > F.ceil(F.lit(float(n_docs)) * F.lit(float(max_df)))).orderBy(F.desc("df"), "word").limit(show)


def transform(docs: DataFrame, vocab: DataFrame, keep_empty: bool = False) -> DataFrame:
    """docs with only their words in vocab, in order. Documents emptied so are dropped unless kept."""
    t = docs.select("doc_id", F.posexplode("tokens").alias("pos", "word")).join(vocab.select("word"), "word", "left_semi")
    kept = t.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]).alias("tokens"))
    if keep_empty:
        return docs.drop("tokens").join(kept, "doc_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    return docs.drop("tokens").join(kept, "doc_id")


def dropped_documents(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return docs.join(kept, "doc_id", "left_anti")


def oov_rate(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, n, oov): the share of each document's tokens that vocab lacks."""
    known = vocab.select("word", F.lit(1).alias("known"))
    return bag(docs).join(known, "word", "left").groupBy("doc_id").agg(
        F.sum("n").alias("n"), (F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("oov"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size("tokens").cast("long").alias("length"))


def stopword_candidates(vocab: DataFrame, n_docs: int, kind: str, show: int = 20, share: float = 0.5, short: int = 3) -> DataFrame:
    """Words that could be stopped: 'frequent' (df over a share), 'short', 'numeric', 'non_alpha', each most frequent first."""
    test: dict[str, tuple[Column, str]] = {
        "frequent": (F.col("df") > share * n_docs, "df"), "short": ((F.char_length("word") < short) & ~T.is_numeric(F.col("word")), "cf"),
        "numeric": (T.is_numeric(F.col("word")), "cf"), "non_alpha": (T.mostly_non_alpha(F.col("word")), "cf")}
    where, by = test[kind]
    return vocab.where(where).orderBy(F.desc(by), "word").limit(show)


def removal_curve(docs: DataFrame, vocab: DataFrame, thresholds: Iterable[int]) -> DataFrame:
    """(threshold, words, tokens, docs) that a least document count would remove. thresholds are few and named by the caller."""
    t = sorted(set(thresholds))
    marks = F.explode(F.array(*[F.lit(x) for x in t]))
    words = vocab.select("word", "cf", "df", marks.alias("threshold")).groupBy("threshold").agg(
        F.count(F.when(F.col("df") < F.col("threshold"), 1)).alias("words"), F.sum(F.when(F.col("df") < F.col("threshold"), F.col("cf")).otherwise(0)).alias("tokens"))
    best = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("word")).join(vocab.select("word", "df"), "word").groupBy("doc_id").agg(F.max("df").alias("best"))
    gone = best.select("best", marks.alias("threshold")).groupBy("threshold").agg(F.count(F.when(F.col("best") < F.col("threshold"), 1)).alias("docs"))
    return words.join(gone, "threshold")


def top_words(weights: DataFrame, by: str, value: str, n: int, word: str = "word") -> DataFrame:
    """The n greatest rows of each group, ties to the smaller word, with rank from 1."""
    w = Window.partitionBy(by).orderBy(F.desc(value), word)
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def web_leak(vocab: DataFrame) -> DataFrame:
    return vocab.where(F.col("word").isin(*T.WEB_WORDS))


def refine_keywords(keywords: DataFrame, vocab: DataFrame, min_count: int = 1, min_df: int = 1) -> DataFrame:
    """(topic, word, cf, df) of keywords frequent enough; missing words count 0."""
    j = keywords.join(vocab, "word", "left").select("topic", "word", F.coalesce("cf", F.lit(0)).alias("cf"), F.coalesce("df", F.lit(0)).alias("df"))
    return j.where((F.col("cf") >= min_count) & (F.col("df") >= min_df))


def merge_vocabularies(a: DataFrame, b: DataFrame) -> DataFrame:
    """(word, cf_a, cf_b) over the union, 0 where a side lacks a word."""
    return a.select("word", F.col("cf").alias("cf_a")).join(b.select("word", F.col("cf").alias("cf_b")), "word", "full").select(
        "word", F.coalesce("cf_a", F.lit(0)).alias("cf_a"), F.coalesce("cf_b", F.lit(0)).alias("cf_b"))
