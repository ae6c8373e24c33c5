"""Comparing fits: one-to-one topic matches, stability, and chains of draws. K x K and draws are small and local."""

from __future__ import annotations

import math

import numpy as np


def assign(cost: np.ndarray) -> list[int]:
    """The column of each row in the cheapest one-to-one assignment (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        back = assign(cost.T)
        out = [-1] * n
        for c, r in enumerate(back):
            out[r] = c
        return out
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        dist, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, at, base = i, -1, 0.0
        while True:
            reduced = base + cost[row] - u[row] - v
            closer = ~done & (reduced < dist)
            dist[closer], prev[closer] = reduced[closer], at
            j = int(np.where(done, np.inf, dist).argmin())
            base = dist[j]
            done[j] = True
            if match[j] < 0:
                break
            row, at = match[j], j
        for c in np.flatnonzero(done):
            if c != j:
                u[match[c]] += base - dist[c]
                v[c] -= base - dist[c]
        u[i] += base
        while j >= 0:
            before = prev[j]
            match[j] = i if before < 0 else match[before]
            j = before
    out = [-1] * n
    for c, r in enumerate(match):
        if r >= 0:
            out[r] = c
    return out


def match_topics(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, float]]:
    """(topic of a, topic of b, cosine) of the best one-to-one match of rows over one vocabulary."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = unit(a) @ unit(b).T
    return [(i, j, float(s[i, j])) for i, j in enumerate(assign(-s)) if j >= 0]


def stability(fits: list[np.ndarray]) -> dict:
    """The mean matched cosine of each topic of the first fit over the others, and of all."""
    per = np.array([[c for _, _, c in match_topics(fits[0], f)] for f in fits[1:]])
    return {"topics": per.mean(axis=0).tolist(), "mean": float(per.mean())}


def autocovariance(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float) - np.mean(x)
    n = len(x)
    f = np.fft.rfft(x, 2 * n)
    return np.fft.irfft(f * np.conj(f))[:n] / n


def ess(chains: np.ndarray) -> float:
    """Effective draws of chains (chains x draws) by Geyer's initial monotone sequence."""
    c = np.atleast_2d(np.asarray(chains, float))
    m, n = c.shape
    acov = np.array([autocovariance(x) for x in c])
    w = (acov[:, 0] * n / (n - 1)).mean()
    plus = w * (n - 1) / n + (c.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    if plus <= 0:
        return float(m * n)
    rho = 1 - (w - acov.mean(axis=0) * n / (n - 1)) / plus
    rho[0] = 1
    total, last = 0.0, math.inf
    for t in range(0, n - 1, 2):
        pair = rho[t] + rho[t + 1]
        if pair < 0:
            break
        last = min(last, pair)
        total += last
    return float(m * n / max(2 * total - 1, 1 / math.log10(max(m * n, 10))))


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """By bisection on the error function."""
    low, high = np.full(p.shape, -9.0), np.full(p.shape, 9.0)
    cdf = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))
    for _ in range(60):
        mid = (low + high) / 2
        up = cdf(mid) < p
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def rhat(chains: np.ndarray) -> float:
    """Split, rank-normalised potential scale reduction."""
    c = np.atleast_2d(np.asarray(chains, float))
    half = c.shape[1] // 2
    s = np.concatenate((c[:, :half], c[:, -half:]))
    flat = s.ravel()
    order = flat.argsort(kind="stable")
    ranks = np.empty(len(flat))
    ranks[order] = np.arange(1, len(flat) + 1)
    _, inv = np.unique(flat, return_inverse=True)
    ranks = (np.bincount(inv, ranks) / np.bincount(inv))[inv]
    z = _normal_quantile((ranks - 0.375) / (len(flat) + 0.25)).reshape(s.shape)
    w, b = z.var(axis=1, ddof=1).mean(), half * z.mean(axis=1).var(ddof=1)
    return float(math.sqrt(((half - 1) / half * w + b / half) / w)) if w > 0 else 1.0


def geweke(x: np.ndarray, first: float = 0.1, last: float = 0.5) -> float:
    """z of the means of a chain's beginning and end, with spectral errors from effective draws."""
    x = np.asarray(x, float)
    a, b = x[: int(first * len(x))], x[-int(last * len(x)) :]
    var = a.var(ddof=1) / max(ess(a), 1) + b.var(ddof=1) / max(ess(b), 1)
    return float((a.mean() - b.mean()) / math.sqrt(var)) if var > 0 else 0.0
