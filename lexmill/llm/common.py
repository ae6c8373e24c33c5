"""Helpers shared by the training-data operators: checkpoints, bounded broadcasts, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graph import components
from ..functions.lineage import cut, scratch, shared_dir

__all__ = ["components", "cut", "fresh", "release", "roots", "scratch", "shared_dir", "small", "tuned"]

#: A side is broadcast only when it has been counted and takes no more bytes than this.
BROADCAST_BYTES = 16 << 20
#: Rows and bytes of one Arrow batch, whichever comes first.
ARROW_ROWS, ARROW_BYTES = 4096, 2 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of operators that ship whole texts or blocks to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def release() -> None:
    """Gives a worker's unused Arrow memory back before the worker idles or serves another task."""
    pa.default_memory_pool().release_unused()


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have, whatever the case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def small(df: DataFrame, weight: Column | None = None, width: int = 16) -> DataFrame:
    """df with a broadcast hint if a count shows that it is within the bound, else df as it is. df should be cut.

    A row counts as width bytes, or as weight times width where a weight is given (entries of an array, say).
    """
    rows = BROADCAST_BYTES // width
    if df.limit(rows + 1).count() > rows:
        return df
    return F.broadcast(df) if weight is None or (df.agg(F.sum(weight)).first()[0] or 0) <= rows else df


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each of n nodes' components, from edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
