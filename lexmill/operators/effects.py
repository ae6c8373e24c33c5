"""Covariate effects: least squares and generalised linear fits from aggregated cross products.

Rows are never collected: one aggregation gives the p x p cross products (p columns), which the driver solves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import chi2_tail, normal_p


def _cols(x: Sequence[str], intercept: bool) -> list[Column]:
    return ([F.lit(1.0)] if intercept else []) + [F.col(c).cast("double") for c in x]


def _moments(df: DataFrame, cols: list[Column], y: Column, w: Column):
    p = len(cols)
    sums = [F.sum(w * cols[i] * cols[j]) for i in range(p) for j in range(i, p)] + [F.sum(w * c * y) for c in cols] + [F.sum(w * y * y), F.count("*"), F.sum(w), F.sum(w * y)]
    r = [float(v or 0) for v in df.agg(*[s.alias(f"m{i}") for i, s in enumerate(sums)]).first()]
    xx, k = np.zeros((p, p)), 0
    for i in range(p):
        for j in range(i, p):
            xx[i, j] = xx[j, i] = r[k]
            k += 1
    return xx, np.array(r[k : k + p]), r[k + p], int(r[k + p + 1]), r[k + p + 2], r[k + p + 3]


def ols(df: DataFrame, y: str, x: Sequence[str], weight: str | None = None, intercept: bool = True, robust: str | None = None, cluster: str | None = None) -> dict:
    """Coefficients, standard errors, z and two-sided p, with n, dof, sigma2 and r2. Rows with a null are left out.

    robust 'hc1' scales the sandwich by n / (n - p); cluster adds G / (G - 1) * (n - 1) / (n - p) over groups.
    """
    names = (["intercept"] if intercept else []) + list(x)
    cols, w = _cols(x, intercept), F.col(weight).cast("double") if weight else F.lit(1.0)
    df = df.dropna(subset=[y, *x, *([weight] if weight else []), *([cluster] if cluster else [])])
    target = F.col(y).cast("double")
    xx, xy, yy, n, sw, sy = _moments(df, cols, target, w)
    inv = np.linalg.pinv(xx)
    beta = inv @ xy
    p = len(cols)
    rss = max(0.0, yy - float(beta @ xy))
    dof = max(1, n - p)
    fit = sum((F.lit(float(b)) * c for b, c in zip(beta, cols, strict=True)), F.lit(0.0))
    e = target - fit
    if cluster:
        scores = df.groupBy(cluster).agg(*[F.sum(w * e * c).alias(f"s{i}") for i, c in enumerate(cols)])
        meat_row = scores.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(p)]).first()
        g = meat_row["g"]
        meat = np.array([[float(meat_row[f"m{i}_{j}"] or 0) for j in range(p)] for i in range(p)])
        cov = inv @ meat @ inv * (g / max(1, g - 1)) * ((n - 1) / dof)
    elif robust:
        row = df.agg(*[F.sum(w * w * e * e * cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(p) for j in range(p)]).first()
        meat = np.array([[float(row[f"m{i}_{j}"] or 0) for j in range(p)] for i in range(p)])
        cov = inv @ meat @ inv * (n / dof if robust == "hc1" else 1.0)
    else:
        cov = inv * rss / dof
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    z = [float(b / s) if s > 0 else math.nan for b, s in zip(beta, se, strict=True)]
    tss = yy - sy * sy / sw if sw and intercept else yy
    return {"names": names, "beta": beta.tolist(), "se": se.tolist(), "z": z, "p": [normal_p(v) if v == v else math.nan for v in z], "cov": cov,
            "n": n, "dof": dof, "sigma2": rss / dof, "r2": 1 - rss / tss if tss else math.nan}


def effect_table(spark, fit: dict) -> DataFrame:
    rows = [(n, b, s) for n, b, s in zip(fit["names"], fit["beta"], fit["se"], strict=True)]
    return spark.createDataFrame(rows, "term string, estimate double, se double")


def topic_effects(theta: DataFrame, design: DataFrame, x: Sequence[str], **how) -> dict:
    """A fit of each topic's share on a design (doc_id and columns x). More than 10,000 topics raise an error."""
    names = [r["topic"] for r in theta.select("topic").distinct().orderBy("topic").limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("more than 10,000 topics")
    j = theta.join(design, "doc_id")
    return {t: ols(j.where(F.col("topic") == F.lit(t)), "p", x, **how) for t in names}


def glm(df: DataFrame, y: str, x: Sequence[str], link: str = "logit", rounds: int = 50, tol: float = 1e-9) -> dict:
    """Quasi-likelihood fit with a logit or log link by reweighted least squares, with a robust (HC0) sandwich."""
    cols, target = _cols(x, True), F.col(y).cast("double")
    df = df.dropna(subset=[y, *x]).persist()
    p = len(cols)
    beta = np.zeros(p)
    mean = float(df.agg(F.avg(target)).first()[0] or 0.5)
    mean = min(max(mean, 1e-6), 1 - 1e-6 if link == "logit" else math.inf)
    beta[0] = math.log(mean / (1 - mean)) if link == "logit" else math.log(mean)

    def parts(beta):
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, cols, strict=True)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta)) if link == "logit" else F.exp(eta)
        return mu, mu * (1 - mu) if link == "logit" else mu

    for _ in range(rounds):
        mu, v = parts(beta)
        row = df.agg(*[F.sum(v * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(p)], *[F.sum((target - mu) * c).alias(f"g{i}") for i, c in enumerate(cols)]).first()
        h = np.array([[float(row[f"h{i}_{j}"]) for j in range(p)] for i in range(p)])
        step = np.linalg.pinv(h) @ np.array([float(row[f"g{i}"]) for i in range(p)])
        beta += step
        if np.abs(step).max() < tol:
            break
    mu, v = parts(beta)
    row = df.agg(*[F.sum(v * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(p)],
                 *[F.sum((target - mu) * (target - mu) * cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(p) for j in range(p)]).first()
    get = lambda k: np.array([[float(row[f"{k}{i}_{j}"]) for j in range(p)] for i in range(p)])
    inv = np.linalg.pinv(get("h"))
    cov = inv @ get("m") @ inv
    df.unpersist()
    return {"names": ["intercept", *x], "beta": beta.tolist(), "se": np.sqrt(np.maximum(np.diag(cov), 0)).tolist(), "cov": cov}


def pool(fits: Sequence[dict]) -> dict:
    """Rubin's rules over draws: the mean within covariance plus (1 + 1 / M) times the coefficients' covariance."""
    b = np.array([f["beta"] for f in fits])
    within = np.mean([f["cov"] for f in fits], axis=0)
    between = np.atleast_2d(np.cov(b.T, ddof=1)) if len(fits) > 1 else np.zeros_like(within)
    cov = within + (1 + 1 / len(fits)) * between
    beta, se = b.mean(axis=0), np.sqrt(np.diag(cov))
    return {"names": fits[0]["names"], "beta": beta.tolist(), "se": se.tolist(), "p": [normal_p(x / s) if s > 0 else math.nan for x, s in zip(beta, se, strict=True)], "cov": cov}


def residual_dispersion(statistic: float, dof: float) -> dict:
    """Pearson dispersion with its chi-square tail."""
    return {"dispersion": statistic / dof, "p": chi2_tail(statistic, dof)}


def group_effect(df: DataFrame, y: str, by: str) -> DataFrame:
    """(group, n, mean, se): group means with robust (HC1) errors, in one aggregation."""
    k = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("group")).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("v"))
    total = k.agg(F.sum("n").alias("total"), F.count("*").alias("g"))
    return k.join(F.broadcast(total), F.lit(True)).select("group", "n", "mean", F.sqrt(F.col("v") / F.col("n") * F.col("total") / (F.col("total") - F.col("g"))).alias("se"))
