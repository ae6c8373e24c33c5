"""Agreement of two partitions from their contingency table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(df: DataFrame, a: str, b: str, noise=-1) -> DataFrame:
    """(a, b, n); rows with noise or null on either side are left out."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a).cast("string") != str(noise)) & (F.col(b).cast("string") != str(noise))
    return df.where(ok).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, purity, ari, nmi, homogeneity, completeness, v_measure. Degenerate tables score 1."""
    c = contingency(df, a, b)
    rows = c.groupBy("a").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    cols = c.groupBy("b").agg(F.sum("n").alias("n"))
    two = lambda x: x * (x - 1) / 2
    n = F.col("n").cast("double")
    xlogx = F.sum(n * F.log(n))
    s = c.agg(F.sum(two(n)).alias("pairs"), xlogx.alias("lc"), F.sum(n).alias("n"))
    r = rows.agg(F.sum(two(n)).alias("pa"), xlogx.alias("la"), F.sum("top").alias("top"))
    k = cols.agg(F.sum(two(n)).alias("pb"), xlogx.alias("lb"))
    j = s.join(r, F.lit(True)).join(k, F.lit(True))  # three single rows
    total, expected = F.col("n"), F.col("pa") * F.col("pb") / two(F.col("n"))
    top = (F.col("pa") + F.col("pb")) / 2
    ari = F.when(top == expected, 1.0).otherwise((F.col("pairs") - expected) / (top - expected))
    ha, hb = F.log(total) - F.col("la") / total, F.log(total) - F.col("lb") / total
    mi = (F.col("lc") - F.col("la") - F.col("lb")) / total + F.log(total)
    j = j.select(total.cast("long").alias("n"), (F.col("top") / total).alias("purity"), ari.alias("ari"), ha.alias("ha"), hb.alias("hb"), mi.alias("mi"))
    h = F.when(F.col("hb") <= 1e-15, 1.0).otherwise(F.col("mi") / F.col("hb"))
    cmp = F.when(F.col("ha") <= 1e-15, 1.0).otherwise(F.col("mi") / F.col("ha"))
    nmi = F.when(F.col("ha") + F.col("hb") <= 1e-15, 1.0).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb")))
    j = j.select("n", "purity", "ari", nmi.alias("nmi"), h.alias("homogeneity"), cmp.alias("completeness"))
    v = F.when(F.col("homogeneity") + F.col("completeness") == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness")))
    return j.withColumn("v_measure", v)
