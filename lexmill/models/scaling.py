"""Positions of authors from word counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scale_counts(y: np.ndarray, iters: int = 100, tol: float = 1e-6, ridge: float = 1.0):
    """(theta, alpha, psi, beta, history) of counts of authors x words, theta standardised; alternating Newton steps."""
    alpha = np.log(np.maximum(y.sum(axis=1), 0.5) / max(y.sum(axis=1).mean(), 0.5))
    psi = np.log(np.maximum(y.mean(axis=0), 1e-3))
    resid = np.log(y + 0.1) - alpha[:, None] - psi
    u, s, vt = np.linalg.svd(resid - resid.mean(axis=0), full_matrices=False)
    theta, beta, last, history = u[:, 0], vt[0] * s[0], -np.inf, []
    for it in range(iters):
        theta = (theta - theta.mean()) / max(theta.std(), 1e-12)
        for _ in range(3):  # words: psi and beta
            mu = np.exp(np.clip(alpha[:, None] + psi + theta[:, None] * beta, -30, 30))
            g0, g1 = (y - mu).sum(axis=0), theta @ (y - mu) - beta / ridge
            h00, h01, h11 = mu.sum(axis=0) + 1e-9, theta @ mu, (theta**2) @ mu + 1 / ridge
            det = np.maximum(h00 * h11 - h01**2, 1e-12)
            psi, beta = psi + np.clip((h11 * g0 - h01 * g1) / det, -1, 1), beta + np.clip((h00 * g1 - h01 * g0) / det, -1, 1)
        for _ in range(3):  # authors: alpha and theta
            mu = np.exp(np.clip(alpha[:, None] + psi + theta[:, None] * beta, -30, 30))
            g0, g1 = (y - mu).sum(axis=1), (y - mu) @ beta
            h00, h01, h11 = mu.sum(axis=1) + 1e-9, mu @ beta, mu @ beta**2 + 1e-6
            det = np.maximum(h00 * h11 - h01**2, 1e-12)
            alpha, theta = alpha + np.clip((h11 * g0 - h01 * g1) / det, -1, 1), theta + np.clip((h00 * g1 - h01 * g0) / det, -1, 1)
        mu = np.exp(np.clip(alpha[:, None] + psi + theta[:, None] * beta, -30, 30))
        like = float((y * np.log(mu) - mu).sum())
        history.append((it, like))
        if abs(like - last) < tol * abs(like):
            break
        last = like
    return (theta - theta.mean()) / max(theta.std(), 1e-12), alpha, psi, beta, history


def author_words(docs: DataFrame, author: str) -> DataFrame:
    """(a, w, n): counts of authors' words."""
    return docs.select(F.col(author).alias("a"), F.explode("tokens").alias("w")).where("a is not null").groupBy("a", "w").agg(F.count("*").alias("n"))


class Wordfish:
    """y ~ Poisson(exp(alpha_i + psi_j + beta_j theta_i)) by alternating Newton steps, theta standardised each round.

    Counts are summed in Spark; authors and words are held on the driver, so both are bounded: the max_words most
    frequent words count, and more than max_authors authors are an error.
    """

    def __init__(self, iters: int = 100, tol: float = 1e-6, max_words: int = 20_000, anchors: tuple[str, str] | None = None, ridge: float = 1.0, max_authors: int = 20_000):
        self.iters, self.tol, self.max_words, self.anchors, self.ridge, self.max_authors = iters, tol, max_words, anchors, ridge, max_authors

    def fit(self, docs: DataFrame, author: str):
        n = author_words(docs, author)
        if n.select("a").distinct().limit(self.max_authors + 1).count() > self.max_authors:
            raise ValueError(f"more than {self.max_authors} authors")
        keep = n.groupBy("w").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "w").limit(self.max_words)
        rows = n.join(F.broadcast(keep.select("w")), "w").toPandas()
        self.authors, self.words = sorted(rows["a"].unique()), sorted(rows["w"].unique())
        at, wt = {a: i for i, a in enumerate(self.authors)}, {w: i for i, w in enumerate(self.words)}
        y = np.zeros((len(at), len(wt)))
        y[rows["a"].map(at), rows["w"].map(wt)] = rows["n"]
        theta, alpha, psi, beta, self.fit_history = scale_counts(y, self.iters, self.tol, self.ridge)
        low, high = (at[self.anchors[0]], at[self.anchors[1]]) if self.anchors else (0, 1 if len(at) > 1 else 0)
        if theta[low] > theta[high]:
            theta, beta = -theta, -beta
        self.theta, self.alpha, self.psi, self.beta = theta, alpha, psi, beta
        return self

    def positions(self, spark) -> DataFrame:
        return spark.createDataFrame([(str(a), float(t)) for a, t in zip(self.authors, self.theta, strict=True)], "author string, position double")
