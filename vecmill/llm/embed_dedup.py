"""Near-duplicate embeddings by p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted, and cut into
steps of ``WIDTH``; ``PROJECTIONS`` such numbers make the key of one of
``TABLES`` tables.  For two vectors at cosine 0.98 (Euclidean distance 0.2) one
projection agrees with probability 0.84 and one table with 0.35, so one of
twenty tables with 0.9998, and with more the nearer they are.  Vectors that
share a bucket are compared by their exact cosine in double precision.

Equal vectors are one class with a count.  Buckets are divided into blocks, and
a task compares two blocks at a time, so no bucket has to fit one task; blocks
grow with the root of the bucket, as does the number of times a vector is sent.  Of a
pair that shares several buckets only the first table counts, which the keys of
both show at once: numbers of links are sums, and no pair is emitted.  What
leaves a block are the sums and the components of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import connected_components
from .storage import batch_rows, discarding, materialize, tidy

TABLES, PROJECTIONS, WIDTH, SEED = 20, 6, 1.0, 20240917
#: A bucket of m vectors has about the root of m / BLOCK blocks, each of which meets every other; elements of a similarity matrix.
BLOCK, ELEMENTS = 1024, 1 << 21


def _projection(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, TABLES * PROJECTIONS)), rng.uniform(0.0, WIDTH, TABLES * PROJECTIONS)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; they are scaled by their largest component first, so no square under- or overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def bucket_keys(vectors: np.ndarray) -> np.ndarray:
    """A 64-bit key for each vector (row) and table."""
    directions, shift = _projection(vectors.shape[1])
    unit = unit_vectors(vectors)
    steps = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(vectors), TABLES, PROJECTIONS)
    keys = np.zeros((len(vectors), TABLES), dtype=np.uint64)
    for k in range(PROJECTIONS):
        keys = tx.mix(keys ^ steps[:, :, k])
    return keys


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _with_keys(classes: DataFrame) -> DataFrame:
    """Adds ``keys``; the rows of a batch may have several dimensions."""

    def add(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                keys = pa.array(list(bucket_keys(_matrix(part.column("vector"))).view(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, keys], [*part.schema.names, "keys"])

    return classes.mapInArrow(tidy(add), "class_id long, n long, label_key string, dim int, vector array<double>, keys array<long>")


def _runs(batches, names: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal values in ``names``; a run may span batches and is bounded by two blocks."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_pylist() for n in names]
        keys = list(zip(*columns, strict=True))
        first = 0
        for at in range(len(keys)):
            if keys[at] != last:
                if last is not None:
                    yield pa.Table.from_batches([*held, batch.slice(first, at - first)] if at > first else held)
                held, first, last = [], at, keys[at]
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _links(unit: np.ndarray, keys: np.ndarray, own: np.ndarray, table: int, i: int, j: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the linked pairs of a block pair that no earlier table has, part by part."""
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    step = max(1, ELEMENTS // max(1, len(right)))
    for first in range(0, len(left), step):
        a, b = np.nonzero(unit[left[first : first + step]] @ unit[right].T >= cosine)
        a, b = left[first + a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            new = ~(keys[x, :table] == keys[y, :table]).any(axis=1)
            yield x[new], y[new]


def _hooked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component after the links between rows ``a`` and ``b``."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, root[root]):
            root = root[root]


def _linked(rows: DataFrame, cosine: float) -> DataFrame:
    """``class_id, n, label_key, vector, links, component_id`` of the classes of equal vectors."""
    classes = rows.groupBy("label_key", "vector").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"))
    classes = classes.select("class_id", "n", "label_key", F.size("vector").alias("dim"), "vector")
    classes = materialize(_with_keys(classes), "classes")

    places = classes.select("class_id", "label_key", "dim", F.posexplode("keys").alias("t", "key"))
    bucket = ["label_key", "dim", "t", "key"]
    full = materialize(places.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    entries = materialize(places.join(full, bucket).select("class_id", "t", "key", "size"), "entries")

    blocks = F.expr(f"cast(ceil(sqrt(size / {BLOCK})) as int)")
    entries = entries.withColumn("own", F.pmod(F.xxhash64("class_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    entries = entries.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    group = ["label_key", "dim", "t", "key", "i", "j"]
    tasks = entries.join(classes, "class_id").select(*group, "own", "class_id", "n", "vector", "keys")
    tasks = tasks.repartition(*group).sortWithinPartitions(*group)

    def compare(batches):
        for run in _runs(batches, group):
            t, i, j = (run.column(c)[0].as_py() for c in ("t", "i", "j"))
            ids, n, own = (run.column(c).to_numpy() for c in ("class_id", "n", "own"))
            stack = lambda c, kind: np.concatenate([np.asarray(x.flatten(), dtype=kind).reshape(len(x), -1) for x in run.column(c).chunks])
            keys, unit = stack("keys", np.int64), unit_vectors(stack("vector", np.float64))
            links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for a, b in _links(unit, keys, own, t, i, j, cosine):
                # Counts are whole numbers below 2 ** 53, so sums of doubles are exact.
                links += (np.bincount(a, weights=n[b], minlength=len(ids)) + np.bincount(b, weights=n[a], minlength=len(ids))).astype(np.int64)
                root = _hooked(root, a, b)
            at = np.flatnonzero(links)
            if not len(at):
                continue
            tied = np.flatnonzero(root != np.arange(len(ids)))
            x = np.concatenate([ids[at], ids[tied]])
            to = pa.array([None] * len(at) + ids[root[tied]].tolist(), pa.int64())
            sums = pa.array(np.concatenate([links[at], np.zeros(len(tied), np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(x), to, sums], ["a", "b", "links"])

    with batch_rows(rows.sparkSession, 2000):
        found = materialize(tasks.mapInArrow(tidy(compare), "a long, b long, links long"), "found")
    components = connected_components(found.where("b is not null"))
    sums = found.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    result = classes.select("class_id", "n", "label_key", "vector").join(sums, "class_id", "left").join(components.withColumnRenamed("id", "class_id"), "class_id", "left")
    return materialize(result.select("class_id", "n", "label_key", "vector", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component_id", "class_id").alias("component_id")), "linked")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """Links between vectors of one label: ``vec_id, n_links, component_id, kept, class_id, class_size``.

    vectors: ``vec_id, embedding, label`` (other columns are not read); one row per row.  Two rows
    link if their labels are equal, their dimensions are equal and their cosine reaches ``cosine``.
    n_links counts the other rows that a row links with, copies each; component_id is the smallest
    vec_id reachable.  Rows with a null label, a null vec_id, or a vector that is null, empty, zero
    or holds null or non-finite components link with nothing.  All finite components count, however
    small or large.  Repeated rows are copies that link with each other; very long vectors are taken
    whole; an empty table gives no rows.
    """
    finite = "not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label_key"))
    usable = F.coalesce(F.expr(f"vec_id is not null and label_key is not null and embedding is not null and {finite}"), F.lit(False))
    rows = wide.select("vec_id", F.when(usable, F.col("label_key")).alias("label_key"), F.when(usable, F.col("embedding")).alias("vector"))
    with discarding() as keep:
        result = keep(_linked(rows.where("vector is not null"), cosine))

    joined = rows.join(result, ["label_key", "vector"], "left")
    return joined.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
        F.coalesce("class_id", "vec_id").alias("class_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("class_size"),
    )
