"""K-means on DataFrames of vectors.

The training rows are capped at 256 per cluster, written once, and read by one
job per iteration: centroids are broadcast, in blocks if they are large, every
task sums its vectors by cluster, and one row per task and cluster is shuffled,
its sum as one binary value, so the plan does not depend on the dimensions.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import aggregate as A
from . import kernels as K
from . import sampling as S
from .assign import assign
from .rabitq import rabitq_assign

log = logging.getLogger("vecmill")

#: Bytes of sums that a task gathers; with larger sums it hands on those of each batch.
GATHERED_BYTES = 64 << 20


def normalized(centroids: np.ndarray) -> np.ndarray:
    """Rows of norm one; zero rows stay zero."""
    norm = np.linalg.norm(centroids, axis=1, keepdims=True)
    return np.divide(centroids, norm, out=centroids.copy(), where=norm > 0)


@dataclass
class KMeansModel:
    """Centroids, and the mean that was taken from the vectors if they were centred."""

    centroids: np.ndarray
    metric: str
    mean: np.ndarray | None = None
    iterations: int = 0
    shift: float = math.inf
    history: list[float] = field(default_factory=list)

    def table(self, spark, space: str = "centered") -> DataFrame:
        """``cid, centroid``; ``space`` is ``centered`` or ``original``."""
        c = self.centroids + self.mean if space == "original" and self.mean is not None else self.centroids
        return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(c)], "cid int, centroid array<double>")

    def transform(self, vectors: DataFrame, vector: str = "embedding", approximate: bool = False) -> DataFrame:
        """Label and distance of each vector; ``approximate`` assigns by the quantised index (squared distance only)."""
        if self.mean is not None:
            held = F.array(*[F.lit(float(v)) for v in self.mean])
            vectors = vectors.withColumn(vector, F.zip_with(F.col(vector).cast("array<double>"), held, lambda x, m: x - m))
        if approximate and self.metric == K.L2:
            return rabitq_assign(vectors, self.centroids, vector=vector)
        return assign(vectors, self.centroids, self.metric, vector)


@dataclass
class KMeans:
    """Parameters of the clustering; ``n_cluster`` None takes the number from the number of rows.

    init: ``sample`` (a seeded sample), ``first`` (the smallest keys) or a matrix.  Training stops
    after ``max_iter`` iterations, or when the centroids' squared shift falls below ``tolerance``.
    ``use_residual`` (squared distance only) centres the vectors first.  ``empty_policy``: see
    ``split_empty``.  ``approximate_from``: rows times dimensions from which the quantised index
    assigns while training (squared distance only); None: never.  ``redo``: trainings from other
    seeds, of which the one with the least cost stays.  ``int_centroids``: centroids are rounded to
    whole numbers after each iteration.  ``frozen_centroids``: the first clusters' centroids, which
    stay as they are (new rows can so be clustered beside a trained model's centroids); the others
    are trained.  ``update_index``: the quantised index gets another rotation for each iteration.
    """

    n_cluster: int | None = None
    max_iter: int = 25
    tolerance: float = 1e-4
    metric: str = K.L2
    use_residual: bool = False
    seed: int = 0
    init: str | np.ndarray = "sample"
    empty_policy: str = "split"
    min_points: int = S.MIN_POINTS
    max_points: int = S.MAX_POINTS
    approximate_from: int | None = 1 << 28
    redo: int = 1
    int_centroids: bool = False
    frozen_centroids: np.ndarray | None = None
    update_index: bool = False

    def __post_init__(self):
        if self.n_cluster is not None and self.n_cluster < 1:
            raise ValueError("n_cluster must be at least 1")
        if self.max_iter < 1:
            raise ValueError("max_iter must be at least 1")
        if not self.tolerance > 0:
            raise ValueError("tolerance must be above 0")
        if self.redo < 1:
            raise ValueError("redo must be at least 1")
        if self.frozen_centroids is not None and self.n_cluster is not None and len(self.frozen_centroids) > self.n_cluster:
            raise ValueError("there are more frozen centroids than clusters")
        K.check_metric(self.metric)

    def fit(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> KMeansModel:
        rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
        shape = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi"), F.sum(F.col("x").isNull().cast("int")).alias("nulls")).first()
        n, dim = shape["n"], shape["lo"]
        if not n:
            raise ValueError("there are no vectors")
        if shape["nulls"] or shape["lo"] != shape["hi"] or dim < 1:
            raise ValueError("vectors must have one dimension and no nulls")
        k = self.n_cluster if self.n_cluster is not None else S.auto_k(n)
        if n < k:
            raise ValueError(f"{n} vectors are fewer than {k} clusters")
        if n < k * self.min_points:
            raise ValueError(f"{n} vectors are too few for {k} clusters of {self.min_points}")
        frozen = np.empty((0, dim)) if self.frozen_centroids is None else np.asarray(self.frozen_centroids, dtype=np.float64)
        if frozen.ndim != 2 or frozen.shape[1] != dim or len(frozen) > k:
            raise ValueError(f"frozen centroids must have {dim} dimensions and number {k} at most")

        mean = None
        if self.use_residual and self.metric == K.L2:
            mean = np.array(A.mean_vector(rows, "x").first()["mean"])
            held = F.array(*[F.lit(float(v)) for v in mean])
            rows = rows.withColumn("x", F.zip_with("x", held, lambda a, b: a - b))
            frozen = frozen - mean
        parts = rows.sparkSession.sparkContext.defaultParallelism
        train = S.training_rows(rows, k, n, "vec_id", self.seed, self.max_points)
        # Two copies, so a lost executor does not cost the iterations a recomputation.
        train = train.repartition(parts, "vec_id").persist(StorageLevel.MEMORY_AND_DISK_2)
        try:
            models = []
            for again in range(self.redo if isinstance(self.init, str) and self.init == "sample" else 1):
                centroids = self._seeds(train, k, dim, self.seed + again)
                if self.metric == K.IP:
                    centroids = normalized(centroids)
                centroids[: len(frozen)] = frozen
                models.append(self._lloyd(train, centroids, mean, n * dim, len(frozen)))
            return min(models, key=lambda m: m.history[-1])
        finally:
            train.unpersist()

    def _seeds(self, train: DataFrame, k: int, dim: int, seed: int) -> np.ndarray:
        if isinstance(self.init, np.ndarray):
            if self.init.shape != (k, dim):
                raise ValueError(f"init must have the shape {(k, dim)}")
            return self.init.astype(np.float64)
        if self.init not in ("sample", "first"):
            raise ValueError(f"no init {self.init!r}")
        chosen = S.seed_rows(train, k, "vec_id", seed) if self.init == "sample" else train.orderBy("vec_id").limit(k)
        order = S.sample_order("vec_id", seed) if self.init == "sample" else F.col("vec_id")
        return np.array([r["x"] for r in chosen.orderBy(order, "vec_id").collect()], dtype=np.float64)

    def _lloyd(self, train: DataFrame, centroids: np.ndarray, mean: np.ndarray | None, elements: int, frozen: int = 0) -> KMeansModel:
        approximate = self.metric == K.L2 and self.approximate_from is not None and elements > self.approximate_from
        model = KMeansModel(centroids, self.metric, mean)
        for _ in range(self.max_iter):
            turn = self.seed + model.iterations if self.update_index else self.seed
            sizes, sums, cost = cluster_sums(train, model.centroids, self.metric, approximate, seed=turn)
            new = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], model.centroids)
            sizes[:frozen] = np.maximum(sizes[:frozen], 1)  # a frozen cluster may stay empty
            new, _ = A.split_empty(new, sizes, self.empty_policy, self.seed + model.iterations)
            if self.metric == K.IP:
                new = normalized(new)
            if self.int_centroids:
                new = np.rint(new)
            new[:frozen] = model.centroids[:frozen]
            model.shift = float(((new - model.centroids) ** 2).sum())
            model.centroids, model.iterations = new, model.iterations + 1
            model.history.append(cost)
            log.debug("iteration %d: cost %g, shift %g", model.iterations, cost, model.shift)
            if model.shift < self.tolerance:
                break
        return model


def cluster_sums(rows: DataFrame, centroids: np.ndarray, metric: str, approximate: bool = False, vector: str = "x", seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Sizes, vector sums and total distance of the clusters that the centroids make of ``rows``: one job, k rows come back.

    With more centroids than one broadcast holds, the rows are labelled block by block first.
    """
    from .rabitq import Index

    k, dim = centroids.shape
    whole = len(K.centroid_blocks(centroids)) == 1
    held = rows.sparkSession.sparkContext.broadcast((centroids, Index.build(centroids, seed=seed) if approximate else None) if whole else None)
    source = rows.select(F.col(vector).alias("v"))
    if not whole:
        both = rows.select(F.col(vector).alias("v"), F.col(vector).alias("x"))
        source = rabitq_assign(both, centroids, seed=seed, vector="x") if approximate else assign(both, centroids, metric, "x")

    def labelled(batch, x):
        if not whole:
            return batch.column("label").to_numpy().astype(np.int64), batch.column("distance").to_numpy()
        centroids, index = held.value
        return index.nearest(x) if index else K.nearest(x, centroids, metric)

    found = _summed(source, labelled, k, dim)
    held.unpersist()
    return found


def _summed(source: DataFrame, labelled, k: int, dim: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Sizes, sums of the vectors ``v`` and total distance by the labels and distances that ``labelled`` gives to a batch."""
    gathered = k * dim * 8 <= GATHERED_BYTES

    def partial(batches):
        n, total, cost = (np.zeros(k, np.int64), np.zeros((k, dim)), np.zeros(k)) if gathered else (None, None, None)
        for batch in batches:
            x = K.matrix(batch.column("v"), dim)
            if not len(x):
                continue
            label, best = labelled(batch, x)
            order = np.argsort(label, kind="stable")
            own, starts, size = np.unique(label[order], return_index=True, return_counts=True)
            sums, costs = np.add.reduceat(x[order], starts, axis=0), np.add.reduceat(best[order], starts)
            if gathered:
                n[own] += size
                total[own] += sums
                cost[own] += costs
            else:
                yield _sums_batch(own, size, costs, sums)
        if gathered:
            at = np.flatnonzero(n)
            yield _sums_batch(at, n[at], cost[at], total[at])

    def added(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for cid, n, cost, s in zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "cost", "s")), strict=True):
                x = np.frombuffer(s)
                if cid in found:
                    own = found[cid]
                    own[0], own[1], own[2] = own[0] + n, own[1] + cost, own[2] + x
                else:
                    found[cid] = [n, cost, x]
        cids = sorted(found)
        yield _sums_batch(np.array(cids, dtype=np.int64), np.array([found[c][0] for c in cids], np.int64), np.array([found[c][1] for c in cids], np.float64), [found[c][2] for c in cids])

    schema = "cid long, n long, cost double, s binary"
    merged = source.mapInArrow(partial, schema).repartition("cid").mapInArrow(added, schema).toArrow()
    sizes, total, cost = np.zeros(k, np.int64), np.zeros((k, dim)), 0.0
    cids = merged["cid"].to_numpy()
    sizes[cids] = merged["n"].to_numpy()
    for cid, s in zip(cids.tolist(), merged["s"].to_pylist(), strict=True):
        total[cid] = np.frombuffer(s)
    cost = float(merged["cost"].to_numpy()[np.argsort(cids)].sum())
    return sizes, total, cost


def _sums_batch(cid: np.ndarray, n: np.ndarray, cost: np.ndarray, sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(cost, pa.float64()), pa.array([x.tobytes() for x in sums], pa.binary())], ["cid", "n", "cost", "s"])


def hierarchical(vectors: DataFrame, k_top: int, k_each: int, key: str = "vec_id", vector: str = "embedding", **params) -> np.ndarray:
    """Centroids of a two-level clustering: ``k_each`` in each of ``k_top`` clusters, fewer where a cluster is small.

    All lower clusterings are trained together: a row is compared with the centroids of its own
    upper cluster, so an iteration is one job whatever their number.  ``params`` are those of
    ``KMeans``; the lower level takes neither ``redo`` nor the quantised index nor frozen centroids.
    """
    own = KMeans(k_top, **params)
    if own.use_residual:
        raise ValueError("centred vectors have no common space for two levels")
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    top = own.fit(rows, "vec_id", "x")
    labelled = assign(rows.withColumn("v", F.col("x")), top.centroids, own.metric, "x", keep=["vec_id", "v"]).select("vec_id", "v", F.col("label").alias("parent"))
    labelled = labelled.persist(StorageLevel.MEMORY_AND_DISK_2)
    try:
        sizes = {r["parent"]: r["count"] for r in labelled.groupBy("parent").count().collect()}
        each = {p: min(k_each, sizes.get(p, 0) // max(1, own.min_points)) for p in range(k_top)}
        starts = np.concatenate([[0], np.cumsum([max(1, each[p]) for p in range(k_top)])])
        train, order = _first_of_each(labelled, {p: own.max_points * k for p, k in each.items() if k}, sizes, own.seed), "vec_id" if own.init == "first" else "o"
        seeds = _first_of_each(train, {p: k for p, k in each.items() if k}, None, own.seed, order)
        centroids = np.repeat(top.centroids, np.diff(starts), axis=0)
        taken = dict.fromkeys(range(k_top), 0)
        for r in seeds.orderBy("parent", F.col(order) if order == "vec_id" else S.sample_order("vec_id", own.seed), "vec_id").collect():
            centroids[starts[r["parent"]] + taken[r["parent"]]] = r["v"]
            taken[r["parent"]] += 1
        if own.metric == K.IP:
            centroids = normalized(centroids)
        train = train.persist(StorageLevel.MEMORY_AND_DISK_2)
        for i in range(own.max_iter):
            n, sums, _ = _sums_by_parent(train, centroids, starts, own.metric)
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
            for p in range(k_top):
                if each[p]:
                    span = slice(starts[p], starts[p + 1])
                    new[span] = A.split_empty(new[span], n[span], own.empty_policy, own.seed + i)[0]
            if own.metric == K.IP:
                new = normalized(new)
            if own.int_centroids:
                new = np.rint(new)
            shift = float(((new - centroids) ** 2).sum())
            centroids = new
            if shift < own.tolerance:
                break
        train.unpersist()
        return centroids
    finally:
        labelled.unpersist()


def _first_of_each(rows: DataFrame, most: dict[int, int], sizes: dict[int, int] | None, seed: int, order: str = "o") -> DataFrame:
    """The first ``most`` rows of each parent, by the hash of the key or by the key; parents without a number are left out.

    With ``sizes`` a threshold on the hash leaves little more than that before rows are ranked, so no
    parent's rows meet in one task whole.
    """
    limit = F.create_map(*[F.lit(x) for p, n in most.items() for x in (p, n)])[F.col("parent")]
    rows = rows.where(F.col("parent").isin(list(most)))
    mark = S.sample_order("vec_id", seed)
    if sizes is not None:
        if all(sizes[p] <= n for p, n in most.items()):
            return rows
        draw = F.conv(F.substring(mark, 1, 8), 16, 10).cast("double") / float(1 << 32)
        share = {p: min(1.0, 1.2 * n / sizes[p]) for p, n in most.items()}
        while True:
            some = rows.where(draw < F.create_map(*[F.lit(x) for p, c in share.items() for x in (p, c)])[F.col("parent")])
            left = {r["parent"]: r["count"] for r in some.groupBy("parent").count().collect()}
            short = [p for p, n in most.items() if left.get(p, 0) < min(n, sizes[p])]
            if not short:
                break
            share |= {p: min(1.0, 2 * share[p]) for p in short}
        rows = some
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.col("vec_id") if order == "vec_id" else mark, "vec_id"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def _sums_by_parent(rows: DataFrame, centroids: np.ndarray, starts: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, float]:
    """``cluster_sums`` where a row meets only its parent's centroids; parents go in runs whose centroids fit a broadcast."""
    k, dim = centroids.shape
    n, total, cost = np.zeros(k, np.int64), np.zeros((k, dim)), 0.0
    lo = 0
    while lo < len(starts) - 1:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + K.BROADCAST_BYTES // (dim * 8), "right")) - 1)
        held = rows.sparkSession.sparkContext.broadcast((centroids[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]))

        def labelled(batch, x, held=held, lo=lo):
            own, at = held.value
            parent = batch.column("parent").to_numpy() - lo
            label, best = np.zeros(len(x), np.int64), np.zeros(len(x))
            for p in np.unique(parent):
                some = np.flatnonzero(parent == p)
                found, best[some] = K.nearest(x[some], own[at[p] : at[p + 1]], metric)
                label[some] = found + at[p]
            return label, best

        part = _summed(rows.where(F.col("parent").between(lo, hi - 1)).select("v", "parent"), labelled, int(starts[hi] - starts[lo]), dim)
        held.unpersist()
        n[starts[lo] : starts[hi]], total[starts[lo] : starts[hi]] = part[0], part[1]
        cost += part[2]
        lo = hi
    return n, total, cost


def mini_batch(vectors: DataFrame, k: int, batches: int = 10, key: str = "vec_id", vector: str = "embedding", metric: str = K.L2, seed: int = 0) -> KMeansModel:
    """Mini-batch K-means: each iteration moves the centroids by one hashed part of the rows, ever less as counts grow."""
    draw = F.conv(F.substring(S.sample_order("vec_id", seed), 1, 8), 16, 10).cast("long")
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    centroids = np.array([r["x"] for r in S.seed_rows(rows, k, "vec_id", seed).collect()], dtype=np.float64)
    if metric == K.IP:
        centroids = normalized(centroids)
    counts = np.zeros(k)
    model = KMeansModel(centroids, metric)
    for part in range(batches):
        some = rows.where(draw % batches == part)
        sizes, sums, cost = cluster_sums(some, model.centroids, metric)
        counts += sizes
        rate = np.divide(sizes, counts, out=np.zeros(k), where=counts > 0)[:, None]
        new = model.centroids * (1 - rate) + rate * np.divide(sums, sizes[:, None], out=model.centroids.copy(), where=sizes[:, None] > 0)
        if metric == K.IP:
            new = normalized(new)
        model.shift = float(((new - model.centroids) ** 2).sum())
        model.centroids, model.iterations = new, part + 1
        model.history.append(cost)
    return model


def progressive(vectors: DataFrame, k: int, steps: int = 10, iterations: int = 10, key: str = "vec_id", vector: str = "embedding", seed: int = 0) -> np.ndarray:
    """Centroids trained on ever more principal components: step i takes ``int(dim ** ((1 + i) / steps))`` of them.

    Each step starts from the centroids of the one before, with zeros for the new components.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(F.col(key).alias("vec_id"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    dim = len(rows.first()["v"])
    pca = PCA(k=dim, inputCol="v", outputCol="p").fit(rows)
    turned = pca.transform(rows).select("vec_id", vector_to_array("p").alias("p"))
    centroids: np.ndarray | None = None
    for i in range(steps):
        d = max(1, int(dim ** ((1 + i) / steps)))
        part = turned.select("vec_id", F.slice("p", 1, d).alias("embedding"))
        init = "sample" if centroids is None else np.pad(centroids, ((0, 0), (0, d - centroids.shape[1])))
        centroids = KMeans(k, iterations, seed=seed, init=init).fit(part).centroids
    return centroids @ pca.pc.toArray().T
