"""Smooth functions of a covariate as columns, for designs that Spark evaluates row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_hot(df: DataFrame, column: str, levels: Sequence[str] | None = None, drop_first: bool = True) -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for each level (sorted as text), and their names. More than 1000 levels found raise an error."""
    if levels is None:
        levels = sorted(str(r[0]) for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(1001).collect())
        if len(levels) > 1000:
            raise ValueError(f"{column} has more than 1000 levels")
    names = []
    for x in list(levels)[1 if drop_first else 0 :]:
        name = f"{column}[{x}]"
        df = df.withColumn(name, (F.col(column).cast("string") == x).cast("double"))
        names.append(name)
    return df, names


def b_spline(x: Column, knots: Sequence[float], low: float, high: float, degree: int = 3) -> list[Column]:
    """B-spline basis with the given inner knots by the Cox-de Boor recurrence, which literals unroll."""
    t = [low] * (degree + 1) + sorted(knots) + [high] * (degree + 1)
    x = F.greatest(F.least(x.cast("double"), F.lit(float(high))), F.lit(float(low)))
    last = len(t) - degree - 2
    b = [((x >= t[i]) & ((x < t[i + 1]) if i < last else (x <= t[i + 1]))).cast("double") if t[i] < t[i + 1] else F.lit(0.0) for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        new = []
        for i in range(len(t) - 1 - d):
            left = (x - t[i]) / (t[i + d] - t[i]) * b[i] if t[i + d] > t[i] else F.lit(0.0)
            right = (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * b[i + 1] if t[i + d + 1] > t[i + 1] else F.lit(0.0)
            new.append(left + right)
        b = new
    return b


def natural_spline(x: Column, knots: Sequence[float]) -> list[Column]:
    """Truncated-power basis of a natural cubic spline: linear beyond the outer knots."""
    k = sorted(float(v) for v in knots)
    cube = lambda v: F.pow(F.greatest(x.cast("double") - v, F.lit(0.0)), 3)
    d = lambda j: (cube(k[j]) - cube(k[-1])) / (k[-1] - k[j])
    return [x.cast("double")] + [d(j) - d(len(k) - 2) for j in range(len(k) - 2)]


def interaction(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x * y for x in a for y in b]


def design(df: DataFrame, terms: dict[str, list[Column]], id_col: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """(id, a column for each term's part) and the names."""
    named = {f"{n}{i + 1}" if len(cs) > 1 else n: c for n, cs in terms.items() for i, c in enumerate(cs)}
    return df.select(id_col, *[c.alias(n) for n, c in named.items()]), list(named)
