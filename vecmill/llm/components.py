"""Connected components of a link table, without bringing links to the driver.

Each round maps every vertex to the neighbour (or itself) with the smallest
salted hash and contracts the links by that map.  A vertex stays only if it is
the minimum of its neighbourhood, so the number of vertices falls by a constant
factor in expectation whatever the shape of the graph; hubs cost nothing extra
because each step is a ``min`` with a partial aggregate.  Once few links are left
one task joins them: rounds over a handful of rows cost the driver as many jobs,
plans and broadcasts as rounds over millions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discarding, materialize, tidy

#: Links that one task joins; with more, they are contracted by rounds until so few are left.
FEW = 4096


def connected_components(links: DataFrame) -> DataFrame:
    """Component of each linked vertex.

    ``links``: two long columns ``a`` and ``b``.  Returns ``id, component_id`` with one row per
    vertex that has a link to another; component_id is the smallest id reachable.  Loops, nulls,
    repeated and reversed links are allowed; an empty table gives an empty table.
    """
    with discarding() as keep:
        return keep(materialize(_components(links), "components"))


def _components(links: DataFrame) -> DataFrame:
    edges = _distinct(links.select("a", "b").where("a is not null and b is not null and a <> b"))
    edges = materialize(edges, "links")
    mapping = None
    rounds = 0
    while left := edges.count():
        rounds += 1
        if left <= FEW:
            step = materialize(edges.coalesce(1).mapInArrow(tidy(_united), "id long, to long"), "step")
            if mapping is None:
                return step.select("id", F.col("to").alias("component_id"))
            mapping = _followed(mapping, step)
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(rounds), c), c.alias("id"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.least(F.min(order(F.col("b"))), order(F.col("a")))["id"].alias("to"))
        step = materialize(step.select(F.col("a").alias("id"), "to"), "step")
        if mapping is None:
            mapping = step
        else:
            mapping = _followed(mapping, step)
        moved = (
            edges.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
            .join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
            .where("a <> b")
        )
        edges = materialize(_distinct(moved), "links")
    if mapping is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    least = materialize(mapping.groupBy("to").agg(F.min("id").alias("component_id")), "least")
    return mapping.join(least, "to").select("id", "component_id")


def _followed(mapping: DataFrame, step: DataFrame) -> DataFrame:
    """Where ``mapping`` leads after one more step."""
    after = mapping.join(step.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    return materialize(after, "components")


def _united(batches):
    """``id, to`` of all ends of some links: the smallest id that each reaches."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], ["id", "to"])


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
