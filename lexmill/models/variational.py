"""LDA and its kin by variational Bayes: documents are fitted where they lie, word statistics are summed in Spark."""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import digamma, trigamma
from .base import Bags, Corpus, TopicModel, bags, mixtures, parts, per_topic, summed
from .spectral import anchor_topics

#: Rounds of a document's fit, and the mean change of its pseudo-counts, as a share of its length, that ends it.
INNER, TOL = 60, 1e-4
#: How far beyond a round's result the next one starts, as a share of the step.
BEYOND = 0.6


def e_steps(bag: Bags, alpha: np.ndarray, beta: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gamma D x K, expected counts of entries x K, log likelihood of documents); beta is exp(E[ln beta]), V x K.

    All documents of the batch advance together; those that have settled leave it. Arrays are K x entries, so that sums
    over a document's entries run along memory.
    """
    d, k = len(bag), beta.shape[1]
    alpha = np.ascontiguousarray(np.broadcast_to(np.asarray(alpha, float), (d, k)).T)
    whole = np.ascontiguousarray(beta[bag.i].T, np.float32)
    if mask is not None:
        whole *= np.repeat(mask.T.astype(np.float32), bag.size, axis=1)
        alpha = np.where(mask.T > 0, alpha, 1e-12)
    total = bag.sums(bag.n)
    gamma = alpha + total / k

    def shares(g):
        return np.exp(digamma(g) - digamma(g.sum(axis=0)))

    def spread(et, size):
        return np.repeat(et.astype(np.float32), size, axis=1)

    live, size, first, b, n = np.arange(d), bag.size, bag.first, whole, bag.n
    for turn in range(INNER):
        old = gamma[:, live]
        et = shares(old)
        norm = np.einsum("ij,ij->j", spread(et, size), b).astype(np.float64) + 1e-100
        new = alpha[:, live] + et * np.add.reduceat(b * (n / norm).astype(np.float32), first, axis=1)
        moving = np.abs(new - old).mean(axis=0) > TOL * total[live] / k + 1e-5
        gamma[:, live] = new
        if not moving.any():
            break
        if turn + 1 < INNER:  # rounds creep along; the fixed point, and what ends a fit, stay the same
            gamma[:, live[moving]] = np.maximum(new + BEYOND * (new - old), alpha[:, live])[:, moving]
        if moving.mean() < 0.7:
            kept = np.repeat(moving, size)
            live, b, n, size = live[moving], b[:, kept], n[kept], size[moving]
            first = np.cumsum(size) - size
    et = spread(shares(gamma), bag.size)
    norm = np.einsum("ij,ij->j", et, whole).astype(np.float64) + 1e-100
    stats = whole * et * (bag.n / norm).astype(np.float32)
    return np.ascontiguousarray(gamma.T), np.ascontiguousarray(stats.T), bag.sums(bag.n * np.log(norm))


def collapsed_steps(bag: Bags, alpha: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As e_steps(), by zero-order collapsed updates: an entry's shares follow from its document's counts less its own.

    beta holds shares of words. All entries of a document move at once.
    """
    d, k = len(bag), beta.shape[1]
    b = beta[bag.i].astype(np.float64)
    share = b / b.sum(axis=1, keepdims=True)
    total = bag.sums(bag.n)
    counts = np.add.reduceat(share * bag.n[:, None], bag.first, axis=0)
    for _ in range(INNER):
        share = (np.broadcast_to(alpha, (d, k)) + counts)[bag.own] - share
        share = np.maximum(share, 1e-12) * b
        share /= share.sum(axis=1, keepdims=True)
        new = np.add.reduceat(share * bag.n[:, None], bag.first, axis=0)
        moved, counts = np.abs(new - counts).mean(axis=1), new
        if (moved <= TOL * total / k + 1e-5).all():
            break
    gamma = alpha + counts
    theta = gamma / gamma.sum(axis=1, keepdims=True)
    p = np.einsum("ij,ij->i", theta[bag.own], b) + 1e-100
    return gamma, share * bag.n[:, None], bag.sums(bag.n * np.log(p))


def short(beta: np.ndarray) -> np.ndarray:
    """K x V as V x K in four bytes, held away from 0, where quotients would overflow."""
    return np.maximum(np.ascontiguousarray(beta.T), 1e-30).astype(np.float32)


def minka(mean: np.ndarray, alpha: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The Dirichlet prior whose expected log shares are the given means (fixed point, with digamma inverted by Newton)."""
    for _ in range(rounds):
        want = mean + digamma(np.array([alpha.sum()]))
        x = np.where(want >= -2.22, np.exp(want) + 0.5, -1 / (want + 0.5772156649015329))
        for _ in range(5):
            x = np.maximum(x - (digamma(x) - want) / trigamma(x), 1e-6)
        done = np.abs(x - alpha).max() < 1e-7
        alpha = x
        if done:
            break
    return alpha


def expected_log(lam: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
    """exp(E[ln beta]) of Dirichlet rows; groups (an index of each word) normalise within languages."""
    if groups is None:
        return np.exp(digamma(lam) - digamma(lam.sum(axis=1, keepdims=True)))
    out = np.empty_like(lam)
    for g in np.unique(groups):
        at = groups == g
        out[:, at] = np.exp(digamma(lam[:, at]) - digamma(lam[:, at].sum(axis=1, keepdims=True)))
    return out


class LDA:
    """Latent Dirichlet allocation. Subclasses change the prior of words, of documents, or the topics a document may use.

    learn_alpha fits the documents' prior, one weight a topic, after each sweep; learn_beta the words', one for all.
    watch(sweep, log likelihood) is called after each sweep; a fit that it answers with False stops there. inference is
    "vb" for variational Bayes or "cvb0" for zero-order collapsed updates, whose word shares are those of counts.
    """

    groups: np.ndarray | None = None

    def __init__(self, k: int, alpha: float | None = None, beta: float = 0.01, iters: int = 100, tol: float = 1e-4, seed: int = 0, learn_alpha: bool = False, learn_beta: bool = False, watch=None, inference: str = "vb"):
        if inference not in ("vb", "cvb0"):
            raise ValueError(inference)
        self.k, self.beta, self.iters, self.tol, self.seed, self.learn_alpha, self.learn_beta, self.watch, self.inference = k, beta, iters, tol, seed, learn_alpha, learn_beta, watch, inference
        self.alpha = np.full(k, alpha if alpha is not None else 50.0 / k if k > 50 else 1.0 / k)

    def settings(self) -> dict:
        return {"model": type(self).__name__, "k": self.k, "beta": self.beta, "iters": self.iters, "seed": self.seed}

    def prior(self, corpus: Corpus) -> np.ndarray:
        return np.full((self.k, corpus.size), self.beta)

    def start(self, corpus: Corpus) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return self.prior(corpus) + rng.gamma(100.0, 0.01, (self.k, corpus.size))

    carry: tuple[str, ...] = ()

    def doc_priors(self, bag: Bags) -> tuple[np.ndarray, np.ndarray | None]:
        """alpha of each document (or of all) and the weights of topics that it may use."""
        return self.alpha, None

    def sweep(self, corpus: Corpus, lam: np.ndarray, rows: DataFrame | None = None) -> tuple[np.ndarray, float]:
        """Summed statistics and the log likelihood of the documents' words under their own mixtures."""
        return self._sweep(corpus, self._weights(lam), rows)

    def _weights(self, lam: np.ndarray) -> np.ndarray:
        return self._phi(lam) if self.inference == "cvb0" else expected_log(lam, self.groups)

    def _sweep(self, corpus: Corpus, beta: np.ndarray, rows: DataFrame | None = None) -> tuple[np.ndarray, float]:
        held, k, v, me = corpus.spark.sparkContext.broadcast(short(beta)), self.k, corpus.size, self._frozen()

        def run(batches):
            total, extra = np.zeros((v, k)), np.zeros(k + 2)
            for bag in bags(batches, k):
                gamma, s, like = me._step(bag, held.value)
                bag.into(total, s)
                extra += np.r_[like.sum(), len(bag), (digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True))).sum(axis=0)]
            yield from parts(total.T, extra)

        stats, extra = summed(corpus.rows if rows is None else rows, run, (k, v), k + 2)
        held.unpersist()
        self.log_shares = extra[2:] / max(extra[1], 1)  # mean expected log shares of topics
        return stats, float(extra[0])

    def _step(self, bag: Bags, beta: np.ndarray):
        alpha, mask = self.doc_priors(bag)
        return collapsed_steps(bag, alpha, beta) if self.inference == "cvb0" and mask is None else e_steps(bag, alpha, beta, mask)

    def _frozen(self):
        """A copy without tables, to be sent to tasks."""
        c = copy.copy(self)
        c.__dict__ = {n: v for n, v in self.__dict__.items() if not isinstance(v, DataFrame) and n not in ("watch", "lam")}
        return c

    def theta(self, corpus: Corpus, lam: np.ndarray) -> DataFrame:
        return self._theta(corpus, self._weights(lam))

    def _theta(self, corpus: Corpus, beta: np.ndarray) -> DataFrame:
        held, me = corpus.spark.sparkContext.broadcast(short(beta)), self._frozen()

        def run(batches):
            for bag in bags(batches, me.k):
                gamma, _, _ = me._step(bag, held.value)
                yield mixtures(bag, gamma / gamma.sum(axis=1, keepdims=True))

        return per_topic(corpus.rows, run)

    def between(self, corpus: Corpus, lam: np.ndarray) -> None:
        """What else is learned between sweeps."""
        if self.learn_alpha:
            self.alpha = minka(self.log_shares, self.alpha)
        if self.learn_beta:
            mean = float((digamma(lam) - digamma(lam.sum(axis=1, keepdims=True))).mean())
            self.beta = float(minka(np.full(lam.shape[1], mean), np.full(lam.shape[1], self.beta), 20).mean())

    def _done(self, history: list[tuple[int, float]]) -> bool:
        if self.watch is not None and self.watch(*history[-1]) is False:
            return True
        return len(history) > 1 and abs(history[-1][1] - history[-2][1]) <= self.tol * abs(history[-2][1])

    def fit(self, corpus: Corpus) -> TopicModel:
        lam, history = self.start(corpus), []
        for it in range(self.iters):
            stats, like = self.sweep(corpus, lam)
            lam = self.prior(corpus) + stats
            history.append((it, like))
            self.between(corpus, lam)
            if self._done(history):
                break
        self.lam = lam
        return TopicModel(corpus.words, self._phi(lam), self.theta(corpus, lam), self.settings(), history)

    def _phi(self, lam: np.ndarray) -> np.ndarray:
        if self.groups is None:
            return lam / lam.sum(axis=1, keepdims=True)
        out = lam.copy()
        for g in np.unique(self.groups):
            out[:, self.groups == g] /= out[:, self.groups == g].sum(axis=1, keepdims=True)
        return out


class OnlineLDA(LDA):
    """Stochastic steps lambda = (1 - rho) lambda + rho (beta + D / B stats), rho = (tau + t)^-kappa, over a fixed vocabulary."""

    def __init__(self, k: int, tau: float = 64.0, kappa: float = 0.7, batches: int = 4, total_docs: int | None = None, **kw):
        super().__init__(k, **kw)
        self.tau, self.kappa, self.batches, self.total_docs, self.t, self.lam = tau, kappa, batches, total_docs, 0, None

    def partial_fit(self, corpus: Corpus, rows: DataFrame | None = None) -> float:
        """One step on a batch of the corpus's rows."""
        rows = corpus.rows if rows is None else rows
        if self.lam is None:
            self.lam = self.start(corpus)
        b = rows.count()
        if not b:
            return 0.0
        self.t += 1
        rho = (self.tau + self.t) ** -self.kappa
        stats, like = self.sweep(corpus, self.lam, rows)
        self.lam = (1 - rho) * self.lam + rho * (self.prior(corpus) + (self.total_docs or b) / b * stats)
        return like

    def state(self) -> bytes:
        """What the next step follows from."""
        return self.lam.tobytes()

    def take(self, raw: bytes) -> None:
        self.lam = np.frombuffer(raw).reshape(self.k, -1).copy()

    def fit(self, corpus: Corpus) -> TopicModel:
        if self.total_docs is None:
            self.total_docs = corpus.rows.count()
        history = []
        for it in range(self.iters):
            part = F.pmod(F.xxhash64("doc_id"), F.lit(self.batches)) == it % self.batches
            history.append((it, self.partial_fit(corpus, corpus.rows.where(part))))
        return TopicModel(corpus.words, self._phi(self.lam), self.theta(corpus, self.lam), self.settings(), history)


class SeededLDA(LDA):
    """Topics named by seed words, whose prior grows by weight times the word's count, or weight * 100 without by_count."""

    def __init__(self, seeds: dict[str, list[str]], residual: int = 0, weight: float = 0.01, by_count: bool = True, **kw):
        super().__init__(len(seeds) + residual, **kw)
        self.seeds, self.weight, self.by_count, self.counts = seeds, weight, by_count, None
        self.names = [*seeds, *[f"other_{i}" for i in range(residual)]]

    def prior(self, corpus: Corpus) -> np.ndarray:
        own = {corpus.index[w] for words in self.seeds.values() for w in words if w in corpus.index}
        if self.by_count and self.counts is None and own:
            e = corpus.rows.select(F.explode(F.arrays_zip("i", "n")).alias("e")).where(F.col("e.i").isin(sorted(own)))
            self.counts = {r["i"]: float(r["n"]) for r in e.groupBy("e.i").agg(F.sum("e.n").alias("n")).collect()}  # a row a seed word
        out = super().prior(corpus)
        for k, words in enumerate(self.seeds.values()):
            for i in {corpus.index[w] for w in words if w in corpus.index}:
                out[k, i] += self.weight * (self.counts.get(i, 0.0) if self.by_count else 100)
        return out

    def start(self, corpus: Corpus) -> np.ndarray:
        lam = super().start(corpus)
        for k, words in enumerate(self.seeds.values()):
            for w in words:
                if w in corpus.index:
                    lam[:, corpus.index[w]] *= 0.1
                    lam[k, corpus.index[w]] += 10.0
        return lam


class LabeledLDA(LDA):
    """Each label is a topic; a document uses those in its column labels, or all if it has none."""

    carry = ("labels",)

    def __init__(self, labels: list[str], **kw):
        super().__init__(len(labels), **kw)
        self.labels, self.at = labels, {x: i for i, x in enumerate(labels)}

    def doc_priors(self, bag):
        mask = np.zeros((len(bag), self.k))
        for d, labels in enumerate(bag.column("labels")):
            mask[d, [self.at[x] for x in labels or () if x in self.at]] = 1
        mask[~mask.any(axis=1)] = 1
        return self.alpha, mask


class DMR(LDA):
    """Document priors exp(features . lambda); lambda climbs the Dirichlet-multinomial likelihood of expected counts."""

    carry = ("features",)

    def __init__(self, k: int, n_features: int, variance: float = 1.0, steps: int = 3, **kw):
        super().__init__(k, **kw)
        self.variance, self.steps = variance, steps
        self.coef = np.zeros((k, n_features + 1))
        self.coef[:, 0] = math.log(1.0 / k)

    @staticmethod
    def design(bag: Bags) -> np.ndarray:
        return np.array([[1.0, *x] for x in bag.column("features")])

    def doc_priors(self, bag):
        return np.exp(np.clip(self.design(bag) @ self.coef.T, -500, 500)) + 1e-10, None

    def between(self, corpus, lam):
        """Steps up the likelihood of the documents' expected counts, which are kept while the coefficients move."""
        held, me, k, width = corpus.spark.sparkContext.broadcast(short(expected_log(lam))), self._frozen(), self.k, self.coef.shape[1]

        def counts(batches):
            for bag in bags(batches, k):
                gamma, _, _ = me._step(bag, held.value)
                c = gamma - me.doc_priors(bag)[0]
                yield pa.RecordBatch.from_arrays([bag.batch.column("features"), pa.array(list(np.maximum(c, 0)), pa.list_(pa.float64()))], ["features", "c"])

        kept = corpus.rows.mapInArrow(counts, f"features {dict(corpus.rows.dtypes)['features']}, c array<double>").persist()
        for _ in range(self.steps):
            coef = self.coef

            def slope(batches, coef=coef):
                grad, scale = np.zeros(coef.shape), np.zeros(coef.shape)
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    x = np.array([[1.0, *f] for f in batch.column(0).to_pylist()])
                    c = batch.column(1).flatten().to_numpy().reshape(len(x), -1)
                    alpha = np.exp(np.clip(x @ coef.T, -500, 500)) + 1e-10
                    a, n = alpha.sum(axis=1, keepdims=True), c.sum(axis=1, keepdims=True)
                    d = digamma(a) - digamma(a + n) + digamma(alpha + c) - digamma(alpha)
                    grad += (alpha * d).T @ x
                    scale += (alpha * np.abs(d) + 1e-6).T @ (x * x)
                yield from parts(np.concatenate((grad, scale), axis=1))

            both, _ = summed(kept, slope, (k, 2 * width))
            grad, scale = both[:, :width] - self.coef / self.variance, both[:, width:] + 1 / self.variance
            self.coef = self.coef + np.clip(0.5 * grad / scale, -0.5, 0.5)
        kept.unpersist()
        held.unpersist()


class PolylingualLDA(LDA):
    """Aligned documents of several languages share a mixture. Words are "lang:word", and topics have words for each language.

    Topics start at anchor words: which words stand in the same mixtures is seen across languages where documents are
    aligned, and tells the topics of unaligned ones apart; a random start leaves each language to fall on topics by chance.
    """

    def start(self, corpus):
        phi, _ = anchor_topics(corpus, self.k, seed=self.seed)
        return 0.1 * super().start(corpus) + corpus.size * phi

    def fit(self, corpus):
        langs = {x: i for i, x in enumerate(sorted({w.split(":", 1)[0] for w in corpus.words}))}
        self.groups = np.array([langs[w.split(":", 1)[0]] for w in corpus.words])
        return super().fit(corpus)
