"""Quantised assignment: centroids as bit codes, a distance bound, exact re-ranking.

Centroids are rotated and centred; the sign of each coordinate is a bit.  From
the bits and a four-bit code of a vector follows a lower bound of its distance
to each centroid, which holds with high probability; only centroids whose bound
is below the best distance so far are compared exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from . import kernels as K

#: Alignment of a degenerate centroid, width of the bound, levels of the vector's code.
DEFAULT_ALIGNMENT, EPSILON, LEVELS = 0.8, 1.9, V.LEVELS
WORD = 64
#: Exact comparisons that are made at a time, and the share of centroids from which all are compared.
PAIRS, OPEN = 1 << 16, 32


def padded(dim: int) -> int:
    """Dimensions rounded up to whole bit words."""
    return -(-dim // WORD) * WORD


def rotation(dim: int, kind: str = "qr", seed: int = 0) -> np.ndarray:
    """Orthogonal matrix of the padded dimension: a seeded random one (``qr``), Hadamard blocks, or the identity."""
    n = padded(dim)
    if kind == "qr":
        return np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]
    if kind == "identity":
        return np.eye(n)
    if kind != "hadamard":
        raise ValueError(f"no rotation {kind!r}")
    at = np.arange(WORD)
    block = np.where(np.bitwise_count(at[:, None] & at[None, :]) % 2 == 0, 1.0, -1.0) / np.sqrt(WORD)
    return np.kron(np.eye(n // WORD), block)


@dataclass
class Index:
    """The quantised centroids; rows of the arrays are slots in ascending distance from the mean."""

    centroids: np.ndarray
    turn: np.ndarray
    mean: np.ndarray
    cid: np.ndarray
    signs: np.ndarray
    center_distance_square: np.ndarray
    factor_ip: np.ndarray
    factor_ppc: np.ndarray
    error_bound: np.ndarray
    dim: int = field(default=0)

    @staticmethod
    def build(centroids: np.ndarray, kind: str = "qr", seed: int = 0, epsilon: float = EPSILON) -> Index:
        centroids = np.asarray(centroids, dtype=np.float64)
        k, dim = centroids.shape
        turn = rotation(dim, kind, seed)
        n = len(turn)
        whole = np.zeros((k, n))
        whole[:, :dim] = centroids
        rotated = whole @ turn
        mean = rotated.mean(axis=0)
        centred = rotated - mean
        radius = np.sqrt((centred**2).sum(axis=1))
        signs = np.where(centred > 0, 1.0, -1.0)
        scale = radius * np.sqrt(n)
        normal = scale > np.finfo(np.float64).tiny
        alignment = np.full(k, DEFAULT_ALIGNMENT)
        alignment[normal] = (centred * signs).sum(axis=1)[normal] / scale[normal]
        ratio = radius / alignment
        ip = -2 / np.sqrt(n) * ratio
        bound = 2 * epsilon / np.sqrt(n - 1) * np.sqrt(np.maximum(ratio**2 - radius**2, 0))
        at = np.lexsort((np.arange(k), radius))
        return Index(whole[at], turn, mean, at, signs[at], (radius**2)[at], ip[at], (ip * signs.sum(axis=1))[at], bound[at], dim)

    def rough(self, rows: np.ndarray, kind=np.float64) -> np.ndarray:
        """Lower bounds of the squared distances, by row and slot: one matrix product of codes and factors."""
        residual = rows @ self.turn - self.mean
        square = (residual**2).sum(axis=1)
        lo, hi = residual.min(axis=1), residual.max(axis=1)
        delta = (hi - lo) / LEVELS
        codes = np.rint((residual - lo[:, None]) / np.where(delta == 0, 1, delta)[:, None])
        codes[delta == 0] = 0
        left = np.column_stack([2 * delta[:, None] * codes, lo, -delta * codes.sum(axis=1), -np.sqrt(square), np.ones(len(rows)), square])
        return left.astype(kind) @ self._right(kind)

    def _right(self, kind) -> np.ndarray:
        held = self.__dict__.setdefault("_factors", {})
        if kind not in held:
            one = np.ones(len(self.cid))
            held[kind] = np.column_stack([(self.signs > 0) * self.factor_ip[:, None], self.factor_ppc, self.factor_ip, self.error_bound, self.center_distance_square, one]).astype(kind).T.copy()
        return held[kind]

    def _whole(self, rows: np.ndarray) -> np.ndarray:
        whole = np.zeros((len(rows), len(self.turn)))
        whole[:, : self.dim] = rows
        return whole

    def retrieve(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label, distance and number of exact comparisons of each row: slots are visited in order, where the bound of some row is below its best."""
        whole = self._whole(rows)
        rough = self.rough(whole)
        best, slot, precise = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for first in range(0, len(self.centroids), WORD):
            block = rough[:, first : first + WORD]
            # What no row's best leaves open now stays closed, as bests only fall.
            for s in (first + np.flatnonzero((block < best[:, None]).any(axis=0))).tolist():
                some = np.flatnonzero(rough[:, s] < best)
                exact = ((whole[some] - self.centroids[s]) ** 2).sum(axis=1)
                better = exact < best[some]
                precise[some] += 1
                best[some[better]], slot[some[better]] = exact[better], s
        return self.cid[slot], best, precise

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label and distance of each row: the centroid of the least bound is compared first, then all whose bounds are below its distance.

        Rows whose bounds leave more than one centroid of OPEN open are compared with all by a matrix product, which is faster then.
        """
        labels, distances = np.empty(len(rows), np.int64), np.empty(len(rows))
        step = max(1, K.BLOCK_ELEMENTS // len(self.cid))
        for at in range(0, len(rows), step):
            whole = self._whole(rows[at : at + step])
            rough = self.rough(whole, np.float32)
            slot = rough.argmin(axis=1)
            best = ((whole - self.centroids[slot]) ** 2).sum(axis=1)
            near = rough < best.astype(np.float32)[:, None]
            wide = np.flatnonzero(near.sum(axis=1, dtype=np.int32) * OPEN > len(self.cid))
            if len(wide):
                near[wide] = False
                slot[wide], best[wide] = K.nearest(whole[wide], self.centroids, K.L2)
            row, other = np.nonzero(near)
            for first in range(0, len(row), PAIRS):
                r, o = row[first : first + PAIRS], other[first : first + PAIRS]
                exact = ((whole[r] - self.centroids[o]) ** 2).sum(axis=1)
                order = np.lexsort((o, exact, r))
                r, o, exact = r[order], o[order], exact[order]
                lead = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                r, o, exact = r[lead], o[lead], exact[lead]
                better = exact < best[r]
                best[r[better]], slot[r[better]] = exact[better], o[better]
            labels[at : at + step], distances[at : at + step] = self.cid[slot], best
        return labels, distances


def rabitq_assign(vectors: DataFrame, centroids: np.ndarray, kind: str = "qr", seed: int = 0, epsilon: float = EPSILON, vector: str = "embedding") -> DataFrame:
    """Approximate nearest centroid (squared distance): ``label, distance, precise`` beside the other columns.

    ``precise`` is the number of exact comparisons of a row; its sum against rows times centroids is
    the pruning ratio.  A map over partitions with the index broadcast; with more centroids than one
    broadcast holds there is an index for each block of them, and a pass for each keeps the better.
    """
    centroids = np.asarray(centroids, dtype=np.float64)
    names = [c for c in vectors.columns if c != vector]
    rows = vectors.select(*names, F.col(vector).alias("_vector"))
    for n, (first, block) in enumerate(K.centroid_blocks(centroids)):
        rows = _index_pass(rows, first, Index.build(block, kind, seed, epsilon), n, names)
    return rows.select(*names, F.col("_label").alias("label"), F.col("_distance").alias("distance"), F.col("_precise").alias("precise"))


def _index_pass(rows: DataFrame, first: int, index: Index, n: int, names: list[str]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(index)
    step = max(1, K.BLOCK_ELEMENTS // max(len(index.cid), len(index.turn)))

    def run(batches):
        index = held.value
        for batch in batches:
            x = K.matrix(batch.column("_vector"), index.dim)
            parts = [index.retrieve(x[at : at + step]) for at in range(0, len(x), step)]
            label, best, precise = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0) for i in range(3))
            label = label + first
            if n:
                had, before = batch.column("_label").to_numpy(), batch.column("_distance").to_numpy()
                precise = precise + batch.column("_precise").to_numpy()
                label, best = np.where(best < before, label, had), np.where(best < before, best, before)
            columns = [*[batch.column(c) for c in [*names, "_vector"]], pa.array(label.astype(np.int32)), pa.array(best.astype(np.float64)), pa.array(precise.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_vector", "_label", "_distance", "_precise"])

    schema = rows.select(*names, "_vector").schema.add("_label", T.IntegerType()).add("_distance", T.DoubleType()).add("_precise", T.LongType())
    return rows.mapInArrow(run, schema)


def metrics(assigned: DataFrame, k: int) -> DataFrame:
    """``rough, precise``: bounds computed and exact comparisons made."""
    return assigned.agg((F.count("*") * k).alias("rough"), F.coalesce(F.sum("precise"), F.lit(0)).alias("precise"))


# The steps of the index as Column expressions, with Hadamard blocks for the rotation.


def project(vector: Column | str, dim: int) -> Column:
    """The vector, padded and rotated by Hadamard blocks."""
    x = V.pad(vector)
    blocks = padded(dim) // WORD
    sign = lambda i, j: F.when(F.bit_count(i.bitwiseAND(j)) % 2 == 0, 1.0).otherwise(-1.0)

    def cell(at: Column) -> Column:
        part = F.slice(x, F.floor(at / WORD).cast("int") * WORD + 1, F.lit(WORD))
        return F.aggregate(F.transform(part, lambda v, i: v * sign(i, at % WORD) / float(WORD**0.5)), F.lit(0.0), lambda s, v: s + v)

    return F.transform(F.sequence(F.lit(0), F.lit(blocks * WORD - 1)), cell)


def centred_centroids(centroids: DataFrame, dim: int) -> DataFrame:
    """``cid, centred, radius`` of rotated centroids (``cid, centroid``) less their mean."""
    from .aggregate import mean_vector

    turned = centroids.select("cid", project("centroid", dim).alias("p"))
    rows = turned.join(F.broadcast(mean_vector(turned, "p"))).select("cid", V.residual("p", "mean").alias("centred"))
    return rows.withColumn("radius", V.l2_norm("centred"))


def factors(centroids: DataFrame, dim: int, epsilon: float = EPSILON) -> DataFrame:
    """``cid, slot, center_distance_square, factor_ip, factor_ppc, error_bound, signs``: the index as a table."""
    from pyspark.sql import Window

    n = padded(dim)
    rows = centred_centroids(centroids, dim).withColumn("signs", V.sign_vector("centred"))
    scale = F.col("radius") * float(n**0.5)
    alignment = F.when(scale > float(np.finfo(np.float64).tiny), V.dot_product("centred", "signs") / scale).otherwise(DEFAULT_ALIGNMENT)
    rows = rows.withColumn("ratio", F.col("radius") / alignment).withColumn("factor_ip", F.lit(-2 / n**0.5) * F.col("ratio"))
    # All centroids are one small table, so their ranks need one task.
    slot = F.row_number().over(Window.orderBy("radius", "cid")) - 1
    return rows.select(
        "cid",
        slot.alias("slot"),
        (F.col("radius") * F.col("radius")).alias("center_distance_square"),
        "factor_ip",
        (F.col("factor_ip") * F.aggregate("signs", F.lit(0), lambda s, v: s + v)).alias("factor_ppc"),
        (F.lit(2 * epsilon / (n - 1) ** 0.5) * F.sqrt(F.greatest(F.col("ratio") * F.col("ratio") - F.col("radius") * F.col("radius"), F.lit(0.0)))).alias("error_bound"),
        "signs",
    )


#: The order of a centroid's factors in array form.
FACTORS = ("factor_ip", "factor_ppc", "error_bound", "center_distance_square")


def factor_array(index: DataFrame) -> DataFrame:
    """``cid, factors``: a centroid's four factors as an array."""
    return index.select("cid", F.array(*FACTORS).alias("factors"))


def factor_columns(arrays: DataFrame) -> DataFrame:
    """The inverse of ``factor_array``; fails on arrays of another length."""
    checked = F.when(F.size("factors") == len(FACTORS), F.col("factors")).otherwise(F.raise_error(F.lit(f"factors must number {len(FACTORS)}")).cast("array<double>"))
    return arrays.select("cid", checked.alias("f")).select("cid", *[F.col("f")[i].alias(name) for i, name in enumerate(FACTORS)])


def quantized(vectors: DataFrame, mean: DataFrame, dim: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, square, lo, delta, codes``: each vector rotated, centred and quantised."""
    rows = vectors.select(key, project(vector, dim).alias("p")).join(F.broadcast(mean)).select(key, V.residual("p", "mean").alias("r"))
    rows = rows.withColumn("lo", F.array_min("r")).withColumn("delta", (F.array_max("r") - F.col("lo")) / float(LEVELS))
    square = F.aggregate(F.transform("r", lambda x: x * x), F.lit(0.0), lambda s, v: s + v)
    return rows.select(key, square.alias("square"), "lo", "delta", V.scalar_quantize("r", "lo", "delta").alias("codes"))


def rough_distances(codes: DataFrame, index: DataFrame, key: str = "vec_id") -> DataFrame:
    """``key, cid, slot, rough``: the bound for each vector and centroid."""
    row = index.agg(F.collect_list(F.struct("cid", "slot", "center_distance_square", "factor_ip", "factor_ppc", "error_bound", "signs")).alias("cs"))
    rows = codes.join(F.broadcast(row)).select("*", F.explode("cs").alias("c")).drop("cs")
    inner = F.aggregate(F.zip_with("codes", F.col("c.signs"), lambda q, s: F.when(s > 0, q).otherwise(0)), F.lit(0), lambda s, v: s + v)
    total = F.aggregate("codes", F.lit(0), lambda s, v: s + v)
    rough = F.col("c.center_distance_square") + F.col("square") + F.col("lo") * F.col("c.factor_ppc") + (2 * inner - total) * F.col("c.factor_ip") * F.col("delta") - F.col("c.error_bound") * F.sqrt("square")
    return rows.select(key, F.col("c.cid").alias("cid"), F.col("c.slot").alias("slot"), rough.alias("rough"))
