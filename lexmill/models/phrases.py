"""Topical n-grams: topics that say single words and carry on phrases.

Every token has a topic and a switch: off, its word comes from the topic's words; on, from what the topic says after the
word before. How likely the switch is follows from the word before and its topic. Given a document's mixture, topics and
switches of its tokens are a chain, solved by forward-backward; a transition is the sum of two products of a row and
a column, so a token costs K, not K square. Pairs of neighbours that are rare in the corpus can't be switched on, so the
chain falls apart before each token that makes no pair with its neighbour: such runs are solved side by side, and a
document takes as many steps as its longest run, not as its tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ENTRIES, Corpus, TopicModel, add_rows, numbered, parts, summed

#: Passes over a document in which its mixture settles.
INNER = 4
#: Numbers in an array of a group of runs, which should stay near the processor.
NEAR = 1 << 16


def chain(w: np.ndarray, b: np.ndarray, size: np.ndarray, theta: np.ndarray, phi: np.ndarray, sigma: np.ndarray, psi: np.ndarray):
    """Posteriors of runs of tokens that stand in columns, the longest first.

    w, b: words and pairs (T x D; pair -1 where there is none); phi V x K, sigma pairs x K, psi V x K. Gives topics (T x D x
    K), topics with the switch on (T x D x K), the topic before of those (T x D x K), and the runs' log likelihood.
    """
    *posts, like = chained(*looked_up(w, b, phi, sigma, psi), size, theta.T)
    return *(x.transpose(0, 2, 1) for x in posts), like


def looked_up(w, b, phi, sigma, psi):
    """What a chain needs of its words and pairs, T x K x D: a word's shares, its pair's, and its switch's."""
    on = b[1:, :, None] >= 0
    none = np.zeros((1, w.shape[1], phi.shape[1]))
    seen = phi[w], np.concatenate((none, np.where(on, sigma[b[1:]], 0.0))), np.concatenate((none, np.where(on, psi[w[:-1]], 0.0)))
    return tuple(np.ascontiguousarray(x.transpose(0, 2, 1)) for x in seen)


def chained(word: np.ndarray, follow: np.ndarray, switch: np.ndarray, size: np.ndarray, theta: np.ndarray, whole: bool = True):
    """As chain(), of what looked_up() gives and mixtures K x D; arrays are T x K x D, so that sums over topics run along memory.

    Unless whole, topics and the likelihood alone are right.
    """
    steps, k, d = word.shape
    live = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    alpha, like = np.zeros((steps, k, d)), np.zeros(d)
    single, pair = theta * word, theta * follow
    ons = []
    for t, n in enumerate(live):
        on = (alpha[t - 1, :, :n] * switch[t, :, :n]).sum(axis=0) if t else np.zeros(n)
        a = single[t, :, :n] * (1 - on) + pair[t, :, :n] * on
        norm = np.maximum(a.sum(axis=0), 1e-300)
        alpha[t, :, :n] = a / norm
        ons.append((on, norm))
        like[:n] += np.log(norm)
    topic, carried, before = (np.zeros_like(alpha) if whole or not j else None for j in range(3))
    beta = np.ones((k, d))
    for t in range(steps - 1, -1, -1):
        n = live[t]
        x, (on, norm) = alpha[t, :, :n] * beta[:, :n], ons[t]
        topic[t, :, :n] = x / np.maximum(x.sum(axis=0), 1e-300)
        y = pair[t, :, :n] * beta[:, :n]
        if whole:
            carried[t, :, :n] = y * (on / norm)
        if t:
            one, two = (single[t, :, :n] * beta[:, :n]).sum(axis=0) / norm, y.sum(axis=0) / norm
            go = switch[t, :, :n]
            if whole:
                before[t, :, :n] = alpha[t - 1, :, :n] * go * two
            beta[:, :n] = one + go * (two - one)
    return topic, carried, before, like


def runs(b: np.ndarray, k: int):
    """(places T x D of the tokens, sizes) of runs of two tokens or more, groups of like length at a time; b: the pair of each token, -1 where a run begins.

    Places beyond a run's end are its last token's. No group's runs differ more than twofold in length.
    """
    first = np.flatnonzero(b < 0)
    size = np.diff(np.append(first, len(b)))
    first, size = first[size > 1], size[size > 1]
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    lo = 0
    while lo < len(size):
        most = int(size[lo])
        hi = min(lo + max(1, NEAR // (most * k)), int(np.searchsorted(-size, -(most // 2), side="left")))
        yield first[lo:hi] + np.minimum(np.arange(most)[:, None], size[lo:hi] - 1), size[lo:hi]
        lo = hi


def settle(w: np.ndarray, b: np.ndarray, own: np.ndarray, docs: int, alpha: float, phi: np.ndarray, sigma: np.ndarray, psi: np.ndarray):
    """Posteriors of documents; w, b, own: word, pair and document of each token, one document after the other.

    Gives the places of tokens that are runs of their own and their topics (K x tokens); the places of the others with
    topics, topics with the switch on, and the topic before of those (tokens x K each); the log likelihood, and mixtures.
    """
    k = phi.shape[1]
    alone = np.flatnonzero((b < 0) & np.append(b[1:] < 0, True))
    doc, word = own[alone], np.ascontiguousarray(phi[w[alone]].T, np.float32)
    many, first = np.bincount(doc, minlength=docs), np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
    groups = []
    for at, size in runs(b, k):
        on = np.arange(len(at))[:, None] < size
        groups.append((at, on, size, own[at[0]], looked_up(w[at], np.where(on, b[at], -1), phi, sigma, psi)))
    theta = np.full((k, docs), 1 / k)
    for turn in range(INNER):
        like, total, posts = 0.0, np.full((k, docs), alpha), []
        spread = np.repeat(theta.astype(np.float32), many, axis=1)
        norm = np.einsum("ij,ij->j", spread, word) + np.float32(1e-37)
        if len(alone):
            total[:, doc[first]] += theta[:, doc[first]] * np.add.reduceat(word / norm, first, axis=1)
            like += float(np.log(norm).sum(dtype=np.float64))
        for _, _, size, of, seen in groups:
            *post, own_like = chained(*seen, size, theta[:, of], turn == INNER - 1)
            posts.append(post)
            like += own_like.sum()
            for j, x in enumerate(post[0].sum(axis=0)):
                total[j] += np.bincount(of, x, docs)
        theta = total / total.sum(axis=0)
    tied = np.concatenate([at[on] for at, on, *_ in groups]) if groups else np.zeros(0, np.int64)
    flat = [np.concatenate([post[j].transpose(0, 2, 1)[on] for (_, on, *_), post in zip(groups, posts, strict=True)]) if groups else np.zeros((0, k)) for j in range(3)]
    return alone, spread * word / norm, tied, *flat, like, theta.T


class TopicalNGrams:
    """fit(docs) of token lists; phrases() gives what its topics carry on, pair_counts (a, b, n) the pairs of word indices. Words are pruned as in Corpus, pairs by min_pair.

    alpha and beta smooth mixtures and words; what a topic says after a word is drawn to what it says anyway by shrink
    tokens, so that a pair as frequent as chance has it gains nothing by the switch; on and off are a switch's prior counts.
    """

    def __init__(self, k: int, alpha: float = 0.1, beta: float = 0.01, shrink: float = 50.0, on: float = 0.1, off: float = 10.0, min_pair: int = 5, iters: int = 60, tol: float = 1e-4, seed: int = 0, watch=None):
        self.k, self.alpha, self.beta, self.shrink, self.on, self.off, self.min_pair, self.iters, self.tol, self.seed, self.watch = k, alpha, beta, shrink, on, off, min_pair, iters, tol, seed, watch

    def _sequences(self, docs: DataFrame, corpus: Corpus) -> DataFrame:
        """(doc_id, w, b): kept words in order, and the pair that each makes with its neighbour before, or -1."""
        spark = corpus.spark
        index = F.broadcast(numbered(spark, corpus.words))  # the vocabulary
        # dealt by documents once, as token lists; counting and listing then stay where a document lies
        tokens = docs.select("doc_id", "tokens").repartition("doc_id").select("doc_id", F.posexplode("tokens").alias("pos", "word")).join(index, "word")
        rows = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "i"))).alias("t")).persist()
        follow = F.filter(F.transform("t", lambda x, j: F.when((j > 0) & (x["pos"] == F.get("t", j - 1)["pos"] + 1), F.struct(F.get("t", j - 1)["i"].alias("a"), x["i"].alias("b")))), lambda x: x.isNotNull())
        self.pair_counts = rows.select(F.inline(follow)).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= self.min_pair).persist()
        held = self.pair_counts.select("a", "b").toArrow()  # all of them: at most one in min_pair tokens
        key = np.sort(held["a"].to_numpy().astype(np.int64) << 32 | held["b"].to_numpy().astype(np.int64))
        self.pairs = np.column_stack((key >> 32, key & 0xFFFFFFFF))
        keys = spark.sparkContext.broadcast(key)

        def run(batches):
            for batch in batches:
                flat, size = batch.column("t").flatten(), pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False)
                i, pos = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "pos"))
                b = np.full(len(i), -1, np.int32)
                if len(keys.value) and len(i) > 1:
                    key = i[:-1] << 32 | i[1:]
                    at = np.minimum(np.searchsorted(keys.value, key), len(keys.value) - 1)
                    b[1:] = np.where((keys.value[at] == key) & (pos[1:] == pos[:-1] + 1), at, -1)
                    b[np.cumsum(size)[:-1]] = -1  # the first of the next document
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (i, b))], ["doc_id", "w", "b"])

        return rows.select("doc_id", "t").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, w array<int>, b array<int>").persist()

    @staticmethod
    def _tokens(batches, k: int):
        """(some documents of the batch, w, b, own, their number): tokens of a bounded number of documents, one after the other."""
        for batch in batches:
            size = pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(size) * k // (4 * ENTRIES)
            ends = [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(size)]
            for lo, hi in zip([0, *ends], ends, strict=False):
                if hi > lo:
                    some = batch.slice(lo, hi - lo)
                    w, b = (some.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("w", "b"))
                    yield some, w, b, np.repeat(np.arange(hi - lo), size[lo:hi]), hi - lo

    def fit(self, docs: DataFrame, **prune) -> TopicModel:
        corpus = Corpus(docs, **prune)
        self.words, v, k, spark = corpus.words, corpus.size, self.k, corpus.spark
        rows = self._sequences(docs, corpus)
        n_pairs, history = len(self.pairs), []
        rng = np.random.default_rng(self.seed)
        phi = rng.gamma(100.0, 0.01, (v, k))
        phi, sigma, psi = phi / phi.sum(axis=0), np.ones((max(1, n_pairs), k)), np.full((v, k), self.on / (self.on + self.off))
        first = np.unique(self.pairs[:, 0], return_index=True)[1]
        sigma[:n_pairs] = self._after(np.ones((n_pairs, k)), phi, first)
        tokens, alpha = self._tokens, self.alpha
        for it in range(self.iters):
            held = spark.sparkContext.broadcast((phi, sigma, psi))

            def run(batches, held=held):
                total, score = np.zeros((v + n_pairs + 2 * v, k)), 0.0
                for _, w, b, own, n in tokens(batches, k):
                    alone, single, tied, topic, carried, before, like, _ = settle(w, b, own, n, alpha, *held.value)
                    add_rows(total, np.concatenate((w[alone], w[tied])), np.concatenate((single.T, topic - carried)))
                    on = b[tied] >= 0
                    past = w[tied[on] - 1]
                    add_rows(total, v + b[tied[on]], carried[on])
                    add_rows(total, v + n_pairs + past, before[on])
                    goes = np.append(b[1:] >= 0, False)[tied]  # tokens that another one of their run follows
                    add_rows(total, 2 * v + n_pairs + w[tied[goes]], topic[goes])
                    score += like
                yield from parts(total.T, [score])

            got, extra = summed(rows.select("w", "b"), run, (k, 3 * v + n_pairs), 1)
            held.unpersist()
            got = got.T
            phi = got[:v] + self.beta
            phi /= phi.sum(axis=0)
            sigma[:n_pairs] = self._after(got[v : v + n_pairs], phi, first)
            went, could = got[v + n_pairs : 2 * v + n_pairs], got[2 * v + n_pairs :]
            psi = (went + self.on) / (could + self.on + self.off)
            history.append((it, float(extra[0])))
            if self.watch is not None and self.watch(*history[-1]) is False:
                break
            if it and abs(history[-1][1] - history[-2][1]) <= self.tol * abs(history[-2][1]):
                break
        self.sigma, self.psi, self.rows = sigma[:n_pairs], psi, rows
        held = spark.sparkContext.broadcast((phi, sigma, psi))

        def mixtures(batches):
            for some, w, b, own, n in tokens(batches, k):
                theta = settle(w, b, own, n, alpha, *held.value)[-1]
                ids = some.column("doc_id").take(pa.array(np.repeat(np.arange(n), k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(theta.ravel())], ["doc_id", "topic", "p"])

        self._held = held
        theta = rows.mapInArrow(mixtures, f"doc_id {dict(rows.dtypes)['doc_id']}, topic int, p double")
        return TopicModel(corpus.words, phi.T.copy(), theta, {"model": "TopicalNGrams", "k": k}, history)

    def _after(self, counts: np.ndarray, phi: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Chances of the pairs' second words after their first (first: where each first word's pairs begin)."""
        if not len(counts):
            return counts
        total = np.repeat(np.add.reduceat(counts, first, axis=0), np.diff(np.append(first, len(counts))), axis=0)
        return (counts + self.shrink * phi[self.pairs[:, 1]]) / (total + self.shrink)

    def phrases(self) -> DataFrame:
        """(topic, phrase, n): runs of words whose switches are rather on than off, under the topic of their last word."""
        tokens, k, alpha, held, words = self._tokens, self.k, self.alpha, self._held, self.rows.sparkSession.sparkContext.broadcast(self.words)

        def run(batches):
            for _, w, b, own, n in tokens(batches, k):
                _, _, tied, topic, carried, _, _, _ = settle(w, b, own, n, alpha, *held.value)
                on, lead = np.zeros(len(w), bool), np.zeros(len(w), np.int32)
                on[tied], lead[tied] = carried.sum(axis=1) > 0.5, topic.argmax(axis=1)  # never at a document's first token
                ends = np.flatnonzero(on & ~np.append(on[1:], False))
                off = np.flatnonzero(~on)
                starts = off[np.searchsorted(off, ends) - 1]
                found = [" ".join(words.value[i] for i in w[s : e + 1].tolist()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(lead[ends]), pa.array(found, pa.string())], ["topic", "phrase"])

        return self.rows.mapInArrow(run, "topic int, phrase string").groupBy("topic", "phrase").agg(F.count("*").alias("n"))
