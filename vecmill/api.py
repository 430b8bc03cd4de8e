"""The clustering API for NumPy callers."""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .operators.assign import assign_single
from .operators.kmeans import KMeans
from .operators.rabitq import rabitq_assign
from .plans.session import ship


class Clusterer:
    """Fit and assign float32 matrices on a Spark session."""

    def __init__(self, spark: SparkSession | None = None, verbose: bool = False):
        self.spark = spark or SparkSession.builder.getOrCreate()
        ship(self.spark)
        if verbose:
            logging.getLogger("vecmill").setLevel(logging.DEBUG)

    def _frame(self, matrix: np.ndarray) -> DataFrame:
        if matrix.ndim != 2:
            raise ValueError("a matrix is needed")
        rows = pa.table({"vec_id": np.arange(len(matrix)), "embedding": pa.array(list(matrix.astype(np.float32)), pa.list_(pa.float32()))})
        return self.spark.createDataFrame(rows)

    def fit(self, vectors: np.ndarray, n_cluster: int, max_iter: int = 25, **params) -> np.ndarray:
        """Centroids of a K-means clustering, one row each."""
        return KMeans(n_cluster, max_iter, **params).fit(self._frame(vectors)).centroids.astype(np.float32)

    def assign(self, vector: np.ndarray, centroids: np.ndarray) -> int:
        """Label of the nearest centroid, exactly."""
        if vector.ndim != 1 or centroids.ndim != 2 or len(vector) != centroids.shape[1]:
            raise ValueError("a vector and a matrix of its dimension are needed")
        table = self._frame(centroids).selectExpr("vec_id as cid", "embedding as centroid")
        return int(assign_single(table, vector.tolist()).first()["label"])

    def batch_assign(self, vectors: np.ndarray, centroids: np.ndarray) -> list[int]:
        """Labels of the nearest centroids by the quantised index; a few may differ from exact ones."""
        if vectors.ndim != 2 or centroids.ndim != 2 or vectors.shape[1] != centroids.shape[1]:
            raise ValueError("two matrices of one dimension are needed")
        found = rabitq_assign(self._frame(vectors), centroids.astype(np.float32)).select("vec_id", "label").toArrow().sort_by("vec_id")
        return found["label"].to_pylist()
