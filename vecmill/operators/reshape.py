"""Vectors to long rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """One row ``key, pos, value`` per element."""
    return vectors.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "value"))


def reshape(flat: DataFrame, key: str, dim: int) -> DataFrame:
    """Rows of ``dim`` elements from long rows: ``key, row, vector``; the last row of a key may be short."""
    row = F.floor(F.col("pos") / dim).cast("int").alias("row")
    rows = flat.groupBy(key, row).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cells"))
    return rows.select(key, "row", F.transform("cells", lambda c: c["value"]).alias("vector"))
