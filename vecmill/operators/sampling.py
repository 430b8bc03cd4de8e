"""Seeded samples of exact size, and the rules for the number of clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points that a cluster should have at least, and takes part in training with at most.
MIN_POINTS, MAX_POINTS = 39, 256


#: Rows that a driver sorts to find where a sample ends, and sample sizes up to which it merges the rows themselves.
SORTED = 10_000


def sample_order(key: str, seed: int = 0) -> Column:
    """A pseudo-random order of rows that depends only on key and seed: hexadecimal digits."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))


def sample_rows(rows: DataFrame, n: int, key: str = "vec_id", seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows, uniformly and without replacement; the same rows for the same seed.

    The rows with the smallest hash of their key.  Small samples are merged from the first rows of
    each partition; for larger ones the hash of the last row is found by counts, digit group by digit
    group, and the rows are filtered by it, so none is sorted or passes the driver.  Fails if there
    are fewer rows.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    have = rows.limit(n).count()
    if have < n:
        raise ValueError(f"{n} rows are asked for, there are {have}")
    if n <= SORTED:
        return rows.orderBy(sample_order(key, seed), key).limit(n)
    order = sample_order(key, seed)
    marks = rows.select(order.alias("o"))
    prefix, left = "", n
    while True:
        part = marks.where(F.col("o").startswith(prefix)).groupBy(F.substring("o", 1, len(prefix) + 4).alias("p")).agg(F.count("*").alias("c"))
        for r in part.orderBy("p").collect():  # 65536 rows at most
            if r["c"] >= left:
                prefix, inside = r["p"], r["c"]
                break
            left -= r["c"]
        if inside <= SORTED or len(prefix) == 32:
            break
    if len(prefix) < 32:
        last = [r["o"] for r in marks.where(F.col("o").startswith(prefix)).orderBy("o").limit(left).collect()]
        prefix, left = last[-1], last.count(last[-1])
    # Rows of one key have one hash; of those at the end as many are taken as are missing.
    return rows.where(order < prefix).unionByName(rows.where(order == prefix).limit(left))


def training_rows(rows: DataFrame, k: int, total: int, key: str = "vec_id", seed: int = 0, most: int = MAX_POINTS) -> DataFrame:
    """The rows themselves, or exactly ``most * k`` of them if there are more."""
    return rows if total <= most * k else sample_rows(rows, most * k, key, seed)


def seed_rows(rows: DataFrame, k: int, key: str = "vec_id", seed: int = 0) -> DataFrame:
    """k rows to start from."""
    return sample_rows(rows, k, key, seed)


def auto_k(n: int) -> int:
    """Number of clusters for n points: four times the root, but 39 points each at least."""
    k = min(math.isqrt(n) * 4, n // MIN_POINTS)
    if k < 1:
        raise ValueError(f"{n} points are too few for a cluster of {MIN_POINTS}")
    return k
