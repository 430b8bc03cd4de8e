"""Aggregations over vectors and their labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Fixed value: relative step by which a split cluster's centroids are moved apart.
EPS = 1 / 1024


def column_mean(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean of each dimension: ``pos, mean``; partial sums per task, D rows at the end."""
    return vectors.select(F.posexplode(V.doubles(vector)).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"))


def mean_vector(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The same as one row with the array ``mean``."""
    return column_mean(vectors, vector).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m")).select(F.transform("m", lambda c: c["mean"]).alias("mean"))


def centroid_residual(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Vectors less the mean of all; the mean is one row, broadcast."""
    columns = [F.col(c) for c in vectors.columns if c != vector]
    return vectors.join(F.broadcast(mean_vector(vectors, vector))).select(*columns, V.residual(vector, "mean").alias(vector))


def cluster_sizes(labels: DataFrame, k: int, label: str = "label") -> DataFrame:
    """``cid, n`` for each of k clusters, empty ones too."""
    counts = labels.groupBy(F.col(label).alias("cid")).agg(F.count("*").alias("c"))
    return labels.sparkSession.range(k).select(F.col("id").cast("int").alias("cid")).join(F.broadcast(counts), "cid", "left").select("cid", F.coalesce("c", F.lit(0)).alias("n"))


def cluster_means(labelled: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean of each cluster and dimension: ``cid, pos, value``; clusters without members have no rows."""
    cells = labelled.select(F.col(label).alias("cid"), F.posexplode(V.doubles(vector)).alias("pos", "x"))
    return cells.groupBy("cid", "pos").agg(F.avg("x").alias("value"))


def centroid_shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Squared distance between two centroid tables (``cid, pos, value``): one row ``value``."""
    both = old.select("cid", "pos", F.col("value").alias("o")).join(new, ["cid", "pos"])
    return both.agg(F.sum((F.col("o") - F.col("value")) * (F.col("o") - F.col("value"))).alias("value"))


def inertia(assigned: DataFrame) -> DataFrame:
    """Sum of distances to the assigned centroids: one row ``value``."""
    return assigned.agg(F.sum("distance").alias("value"))


def split_empty(centroids: np.ndarray, sizes: np.ndarray, policy: str = "split", seed: int = 0, total: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and sizes after each empty cluster got half of another one.

    The donor's centroid is copied; dimension by dimension one copy grows by EPS and the other
    shrinks, in turns.  ``split``: the donor is the first cluster with two members or more;
    ``split_random``: clusters are tried in turn with probability (size - 1) / (points - k);
    ``keep``: empty clusters stay as they are.
    """
    centroids, sizes = centroids.copy(), sizes.copy()
    if policy == "keep":
        return centroids, sizes
    if policy not in ("split", "split_random"):
        raise ValueError(f"no policy {policy!r}")
    rng = np.random.default_rng(seed)
    up = np.where(np.arange(centroids.shape[1]) % 2 == 0, 1 + EPS, 1 - EPS)
    for empty in np.flatnonzero(sizes == 0):
        donors = np.flatnonzero(sizes >= 2)
        if not len(donors):
            break
        donor = donors[0]
        if policy == "split_random":
            chance = (sizes[donors] - 1) / max(1, (total if total is not None else int(sizes.sum())) - len(sizes))
            at = 0
            while rng.random() >= chance[at % len(donors)]:
                at += 1
            donor = donors[at % len(donors)]
        centroids[empty], centroids[donor] = centroids[donor] * up, centroids[donor] * (2 - up)
        sizes[empty] = sizes[donor] // 2
        sizes[donor] -= sizes[empty]
    return centroids, sizes
