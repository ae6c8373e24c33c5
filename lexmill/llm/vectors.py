"""Reading vectors out of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def rows(ids: pa.Array, vectors: pa.Array):
    """For each dimension in the batch (positions in the batch, float64 matrix) of the usable vectors.

    Usable: id and vector aren't null, no component is null or non-finite, at least one component.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = vectors.offsets.to_numpy()
    size = np.diff(offsets)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become nan
    ok = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid()) & (size > 0)
    for dim in np.unique(size[ok]).tolist():
        at = np.flatnonzero(ok & (size == dim))
        x = flat[offsets[at][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(axis=1)
        if good.any():
            yield at[good], x[good]
