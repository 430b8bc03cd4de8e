"""Nearest centroid of each vector: exact assignment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from . import kernels as K


def metric_distance(a: Column | str, b: Column | str, metric: str) -> Column:
    """The distance of a metric as a Column."""
    return V.squared_euclidean(a, b) if K.check_metric(metric) == K.L2 else V.neg_dot_product(a, b)


def assign(vectors: DataFrame, centroids: np.ndarray, metric: str = K.L2, vector: str = "embedding", keep: Sequence[str] | None = None) -> DataFrame:
    """``label`` (int) and ``distance`` of the nearest centroid, beside the columns in ``keep`` (all but the vector).

    Ties go to the lowest label.  A map over partitions: no shuffle, and centroids are broadcast in
    blocks of bounded size, each pass keeping the better of its own and the earlier result.
    """
    centroids = np.asarray(centroids, dtype=np.float64)
    if centroids.ndim != 2 or not len(centroids):
        raise ValueError("centroids must be a matrix with a row at least")
    K.check_metric(metric)
    names = list(keep) if keep is not None else [c for c in vectors.columns if c != vector]
    kept = [f for f in vectors.select(*names).schema.fields] if names else []
    blocks = K.centroid_blocks(centroids)
    rows = vectors.select(*names, F.col(vector).alias("_vector"))
    for n, (first, block) in enumerate(blocks):
        rows = _pass(rows, first, block, metric, n, kept)
    return rows.select(*names, F.col("_label").alias("label"), F.col("_distance").alias("distance"))


def _pass(rows: DataFrame, first: int, block: np.ndarray, metric: str, n: int, kept: list) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(block)
    dim = block.shape[1]

    def run(batches):
        centroids = held.value
        for batch in batches:
            label, best = K.nearest(K.matrix(batch.column("_vector"), dim), centroids, metric)
            label += first
            if n:
                before, had = batch.column("_distance").to_numpy(), batch.column("_label").to_numpy()
                label, best = np.where(best < before, label, had), np.where(best < before, best, before)
            columns = [batch.column(f.name) for f in kept] + [batch.column("_vector"), pa.array(label.astype(np.int32)), pa.array(best)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + ["_vector", "_label", "_distance"])

    schema = rows.select(*[f.name for f in kept], "_vector").schema.add("_label", T.IntegerType()).add("_distance", T.DoubleType())
    return rows.mapInArrow(run, schema)


def assign_join(vectors: DataFrame, centroids: DataFrame, metric: str = K.L2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The same as a plan of built-in expressions: ``key, label, distance``.

    centroids: ``cid, centroid``, few rows.  They become one array that is broadcast, so there is no
    shuffle; meant for checks and small numbers of centroids.
    """
    row = centroids.agg(F.array_sort(F.collect_list(F.struct("cid", "centroid"))).alias("cs"))
    best = F.array_min(F.transform("cs", lambda c: F.struct(metric_distance(vector, c["centroid"], metric).alias("d"), c["cid"].alias("cid"))))
    return vectors.join(F.broadcast(row)).select(key, best.alias("b")).select(key, F.col("b.cid").cast("int").alias("label"), F.col("b.d").alias("distance"))


def assign_single(centroids: DataFrame, vector: Sequence[float], metric: str = K.L2) -> DataFrame:
    """The nearest centroid of one vector: ``label, distance``, one row."""
    x = F.array(*[F.lit(float(v)) for v in vector])
    return centroids.select(F.col("cid").cast("int").alias("label"), metric_distance("centroid", x, metric).alias("distance")).orderBy("distance", "label").limit(1)


def pairwise(vectors: DataFrame, centroids: DataFrame, value, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, cid, value(vector, centroid)`` for all vectors and the few centroids, which are broadcast as one row."""
    row = centroids.agg(F.collect_list(F.struct("cid", "centroid")).alias("cs"))
    return vectors.join(F.broadcast(row)).select(key, vector, F.explode("cs").alias("c")).select(key, F.col("c.cid").alias("cid"), value(F.col(vector), F.col("c.centroid")).alias("value"))


def nearest_rows(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", metric: str = K.L2) -> DataFrame:
    """Exact k nearest vectors of each query: ``qid, rank, key``, ties to the smaller key.

    queries (``qid, query``) are a small stated set, broadcast in blocks; each partition keeps the
    best k of a query, so what is shuffled is k rows a query and partition.
    """
    asked = [(r["qid"], np.asarray(r["query"], dtype=np.float64)) for r in queries.select("qid", "query").toLocalIterator()]
    dim = len(asked[0][1]) if asked else 0
    step = max(1, (K.BROADCAST_BYTES // 8) // max(1, dim * 8))
    found = None
    for at in range(0, len(asked), step):
        part = _nearest_block(vectors, asked[at : at + step], k, key, vector, metric)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "qid long, rank int, vec_id long").withColumnRenamed("vec_id", key)
    order = Window.partitionBy("qid").orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", key)


def _nearest_block(vectors: DataFrame, asked: list, k: int, key: str, vector: str, metric: str) -> DataFrame:
    held = vectors.sparkSession.sparkContext.broadcast((np.array([q for q, _ in asked]), np.stack([x for _, x in asked])))

    def run(batches):
        ids, queries = held.value
        best_d, best_i = [np.empty(0)] * len(ids), [np.empty(0, np.int64)] * len(ids)
        for batch in batches:
            x, own = K.matrix(batch.column("v"), queries.shape[1]), batch.column(key).to_numpy()
            for q, query in enumerate(queries):
                d = -(x @ query) if metric == K.IP else ((x - query) ** 2).sum(axis=1)
                d, i = np.concatenate([best_d[q], d]), np.concatenate([best_i[q], own])
                top = np.lexsort((i, d))[:k]
                best_d[q], best_i[q] = d[top], i[top]
        n = [len(d) for d in best_d]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate(best_i)), pa.array(np.concatenate(best_d))], ["qid", key, "distance"])

    return vectors.select(F.col(key).cast("long").alias(key), F.col(vector).alias("v")).mapInArrow(run, f"qid long, {key} long, distance double")
