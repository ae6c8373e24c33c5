"""Vector expressions over array columns, and numeric helpers that Spark SQL lacks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def softmax(eta: Column) -> Column:
    top = F.array_max(eta)
    e = F.transform(eta, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def digamma(x: np.ndarray) -> np.ndarray:
    """Six steps of the recurrence for all, then the asymptotic series."""
    x = np.array(x, np.float64)
    out = np.zeros_like(x)
    for _ in range(6):
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    out += np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    return out


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64).copy()
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] += 1 / x[low] ** 2
        x[low] += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, dof: float) -> float:
    """Upper tail: the regularised incomplete gamma function by series or continued fraction."""
    a, z = dof / 2, x / 2
    if z <= 0:
        return 1.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h
