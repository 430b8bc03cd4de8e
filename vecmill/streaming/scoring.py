"""Assignment of vectors that arrive as a stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..operators import kernels as K
from ..operators.assign import assign
from ..operators.kmeans import KMeansModel, cluster_sums, normalized


def assign_stream(stream: DataFrame, centroids: np.ndarray, metric: str = K.L2, vector: str = "embedding") -> DataFrame:
    """Label and distance of each row of a streaming DataFrame; stateless, so any output mode and trigger serve."""
    return assign(stream, centroids, metric, vector)


class StreamingKMeans:
    """Centroids that follow a stream; pass ``update`` to ``foreachBatch``.

    Each micro-batch moves a centroid towards the mean of its new members by their share of all it
    has seen; ``decay`` below 1 forgets.  A batch that is repeated after a failure is skipped by its id.
    """

    def __init__(self, centroids: np.ndarray, metric: str = K.L2, decay: float = 1.0, vector: str = "embedding"):
        self.model = KMeansModel(np.asarray(centroids, dtype=np.float64), K.check_metric(metric))
        self.weight = np.zeros(len(self.model.centroids))
        self.decay, self.vector, self.last = decay, vector, -1

    def update(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        sizes, sums, _ = cluster_sums(batch, self.model.centroids, self.model.metric, vector=self.vector)
        self.weight = self.weight * self.decay + sizes
        rate = np.divide(sizes, self.weight, out=np.zeros(len(sizes)), where=self.weight > 0)[:, None]
        means = np.divide(sums, sizes[:, None], out=self.model.centroids.copy(), where=sizes[:, None] > 0)
        new = self.model.centroids * (1 - rate) + rate * means
        self.model.centroids = normalized(new) if self.model.metric == K.IP else new
        self.model.iterations, self.last = self.model.iterations + 1, batch_id
