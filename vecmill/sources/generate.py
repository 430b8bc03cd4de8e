"""Random vector data sets with their exact nearest neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import mean_vector
from ..operators.assign import nearest_rows
from .vecs import write_matrix, write_vecs


def random_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """``vec_id, embedding``: n vectors of whole numbers 0 to 255, made where they are used: two digits of a hash of seed, row and place."""
    digits = lambda p: F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("id").cast("string"), p.cast("string"))), 1, 2)
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda p: F.conv(digits(p), 16, 10).cast("float"))
    return spark.range(n).select(F.col("id").alias("vec_id"), value.alias("embedding"))


def generate(spark: SparkSession, path: str, dim: int = 100, n: int = 1000, queries: int = 10, k: int = 1, seed: int = 0) -> dict[str, DataFrame]:
    """Base vectors, their mean, queries and the k nearest vectors of each, written below ``path`` as vecs files."""
    base, query = random_vectors(spark, n, dim, seed), random_vectors(spark, queries, dim, seed + 1)
    truth = nearest_rows(query.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), base, k)
    lists = truth.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("c")).select(F.col("qid").alias("vec_id"), F.transform("c", lambda c: c["vec_id"].cast("int")).alias("embedding"))
    write_vecs(base, f"{path}/base.fvecs")
    write_vecs(query, f"{path}/query.fvecs")
    write_vecs(lists, f"{path}/groundtruth.ivecs", "int")
    write_matrix(np.array([mean_vector(base).first()["mean"]]), f"{path}/centroids.fvecs")
    return {"base": base, "query": query, "truth": truth}
