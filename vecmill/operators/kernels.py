"""NumPy kernels over Arrow batches, and the checks of what is broadcast to them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of centroids that one broadcast may hold; more are taken in several passes over blocks of centroids.
BROADCAST_BYTES = 256 << 20
#: Elements of a distance block: rows of a batch are taken so many at a time that it stays within 64 MB.
BLOCK_ELEMENTS = 8 << 20

L2, IP = "l2", "ip"


def check_metric(metric: str) -> str:
    if metric not in (L2, IP):
        raise ValueError(f"metric must be {L2!r} or {IP!r}, not {metric!r}")
    return metric


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix; fails on nulls and other lengths."""
    if column.null_count:
        raise ValueError("a vector is null")
    values = column.flatten()
    if values.null_count or len(values) != len(column) * dim or (len(column) and set(np.unique(np.diff(column.offsets.to_numpy())).tolist()) != {dim}):
        raise ValueError(f"vectors must have {dim} elements and no nulls")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def nearest(rows: np.ndarray, centroids: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Position of and distance to the nearest centroid, the first of equals; NaN is never nearest.

    Distances are first taken by a matrix product; where two are so near that its rounding could
    matter, they are taken again from the differences.
    """
    label, best = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
    step = max(1, BLOCK_ELEMENTS // max(1, len(centroids)))
    square = (centroids**2).sum(axis=1)
    for at in range(0, len(rows), step):
        x = rows[at : at + step]
        if metric == IP:
            d = -(x @ centroids.T)
            scale = np.abs(d).max(axis=1, initial=1.0)
        else:
            own = (x**2).sum(axis=1)
            d = square[None, :] - 2 * (x @ centroids.T)
            scale = own + np.abs(d).max(axis=1, initial=1.0)
        d = np.where(np.isnan(d), np.inf, d)
        pick = d.argmin(axis=1)
        least = d[np.arange(len(x)), pick]
        close = d <= (least + 1e-12 * scale)[:, None]
        for i in np.flatnonzero(close.sum(axis=1) > 1):
            some = np.flatnonzero(close[i])
            exact = [distance(x[i], centroids[c], metric) for c in some]
            pick[i] = some[int(np.argmin(exact))]
        label[at : at + step] = pick
        c = centroids[pick]
        best[at : at + step] = -(x * c).sum(axis=1) if metric == IP else ((x - c) ** 2).sum(axis=1)
    return label, best


def distance(x: np.ndarray, c: np.ndarray, metric: str) -> float:
    return float(-(x @ c)) if metric == IP else float(((x - c) ** 2).sum())


def centroid_blocks(centroids: np.ndarray, limit: int = BROADCAST_BYTES) -> list[tuple[int, np.ndarray]]:
    """(first position, centroids) of blocks that fit a broadcast."""
    rows = max(1, limit // max(1, centroids.shape[1] * 8))
    return [(at, centroids[at : at + rows]) for at in range(0, len(centroids), rows)]
