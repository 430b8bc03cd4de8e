"""Assignment, training, quantised assignment and sampling: differential tests and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmill.api import Clusterer
from vecmill.operators import aggregate as A
from vecmill.operators import assign as N
from vecmill.operators import kernels as K
from vecmill.operators import kmeans as M
from vecmill.operators import rabitq as R
from vecmill.operators import sampling as S


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


def labels(df):
    return [r["label"] for r in df.orderBy("vec_id").collect()]


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(3).random((1000, 32)).astype(np.float32)


def test_assign_is_exact_in_all_forms(spark, data):
    v, c = frame(spark, data), data[:25].astype(np.float64)
    exact = [int(np.argmin(np.linalg.norm(c - x, axis=1))) for x in data]
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(c)], "cid int, centroid array<double>")
    assert labels(N.assign(v, c)) == exact
    assert labels(N.assign_join(v, table)) == exact
    assert N.assign_single(table, data[77].tolist()).first()["label"] == exact[77]
    inner = [int(np.argmax(c @ x)) for x in data.astype(np.float64)]
    assert labels(N.assign(v, c, "ip")) == inner


def test_assign_in_blocks_of_centroids(spark, data, monkeypatch):
    v, c = frame(spark, data[:200]), data[:25].astype(np.float64)
    whole = labels(N.assign(v, c))
    monkeypatch.setattr(K, "centroid_blocks", lambda c, limit=0: [(i, c[i : i + 4]) for i in range(0, len(c), 4)])
    assert labels(N.assign(v, c)) == whole


def test_ties_go_to_the_lowest_label(spark):
    v = frame(spark, [[0.0, 0.0]])
    assert labels(N.assign(v, np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]))) == [0]
    assert labels(N.assign(v, np.array([[np.nan, 0.0], [0.0, 1.0]]))) == [1]


def test_assign_rejects_bad_input(spark):
    with pytest.raises(ValueError):
        N.assign(frame(spark, [[1.0]]), np.zeros((1, 1)), "cosine")
    with pytest.raises(ValueError):
        N.assign(frame(spark, [[1.0]]), np.zeros((0, 1)))
    with pytest.raises(Exception, match="must have 2 elements"):
        N.assign(frame(spark, [[1.0]]), np.zeros((1, 2))).collect()


def test_kmeans_against_numpy(spark, data):
    model = M.KMeans(10, 5, init="first", tolerance=1e-300).fit(frame(spark, data))
    x, c = data.astype(np.float64), data[:10].astype(np.float64)
    for _ in range(5):
        own = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.stack([x[own == i].mean(0) for i in range(10)])
    assert np.allclose(model.centroids, c, atol=1e-9)
    assert model.history == sorted(model.history, reverse=True)


def test_kmeans_modes(spark, data):
    v = frame(spark, data)
    inner = M.KMeans(8, 3, metric="ip").fit(v)
    assert np.allclose(np.linalg.norm(inner.centroids, axis=1), 1)
    centred = M.KMeans(8, 3, use_residual=True).fit(v)
    assert np.allclose(centred.mean, data.mean(0), atol=1e-6)
    original = np.array([r["centroid"] for r in centred.table(spark, "original").orderBy("cid").collect()])
    assert labels(centred.transform(v)) == labels(N.assign(v, original))
    capped = M.KMeans(2, 3, max_points=50).fit(v)
    assert capped.centroids.shape == (2, 32)
    assert len(labels(capped.transform(v))) == 1000
    assert np.array_equal(capped.centroids, M.KMeans(2, 3, max_points=50).fit(v).centroids)
    automatic = M.KMeans().fit(v)
    assert len(automatic.centroids) == 25
    quick = M.KMeans(10, 3, approximate_from=0, init="first").fit(v)
    exact = M.KMeans(10, 3, init="first").fit(v)
    assert np.abs(quick.centroids - exact.centroids).max() < 0.2


def test_kmeans_stops_when_it_has_converged(spark, data):
    model = M.KMeans(1, 25).fit(frame(spark, data))
    assert model.iterations == 2 and model.shift < 1e-4


def test_kmeans_guards(spark, data):
    v = frame(spark, data[:100])
    for bad in ({"n_cluster": 0}, {"max_iter": 0}, {"tolerance": 0}, {"metric": "cosine"}):
        with pytest.raises(ValueError):
            M.KMeans(**bad)
    for k, rows in ((101, v), (3, v), (None, frame(spark, data[:20]))):
        with pytest.raises(ValueError):
            M.KMeans(k).fit(rows)
    with pytest.raises(ValueError):
        M.KMeans(1).fit(frame(spark, []))


def test_empty_clusters_are_split():
    c, n = A.split_empty(np.array([[1.0, 1.0], [2.0, 2.0], [9.0, 9.0]]), np.array([1, 5, 0]))
    assert n.tolist() == [1, 3, 2]
    assert c[2].tolist() == [2 * (1 + A.EPS), 2 * (1 - A.EPS)] and c[1].tolist() == [2 * (1 - A.EPS), 2 * (1 + A.EPS)]
    assert A.split_empty(c, np.array([1, 5, 0]), "keep")[1].tolist() == [1, 5, 0]
    assert A.split_empty(c, np.array([1, 5, 0]), "split_random", 1)[1].tolist() == [1, 3, 2]
    assert A.split_empty(c, np.array([0, 1, 0]))[1].tolist() == [0, 1, 0]


def test_far_seed_gets_members(spark, data):
    seeds = data[:5].astype(np.float64)
    seeds[4] = 1e6
    model = M.KMeans(5, 5, init=seeds).fit(frame(spark, data))
    sizes = np.bincount(labels(model.transform(frame(spark, data))), minlength=5)
    assert sizes.sum() == 1000 and sizes.min() > 0


@pytest.mark.parametrize("kind", ["qr", "hadamard", "identity"])
def test_quantised_assignment(spark, data, kind):
    v = frame(spark, data)
    c = M.KMeans(10, 5).fit(v).centroids
    found = R.rabitq_assign(v, c, kind)
    assert np.mean(np.array(labels(found)) == np.array(labels(N.assign(v, c)))) > 0.99
    counts = R.metrics(found, 10).first()
    assert counts["rough"] == 10000 and 1000 <= counts["precise"] < 10000


def test_quantised_edges(spark):
    v = frame(spark, np.ones((3, 70)))
    assert labels(R.rabitq_assign(v, np.ones((1, 70)))) == [0, 0, 0]
    assert labels(R.rabitq_assign(v, np.vstack([np.zeros(70), np.ones(70)]))) == [1, 1, 1]


def test_factor_arrays_have_four_elements(spark):
    short = spark.createDataFrame([(0, [1.0, 2.0])], "cid int, factors array<double>")
    with pytest.raises(Exception, match="must number 4"):
        R.factor_columns(short).collect()


def test_aggregates(spark, data):
    v = frame(spark, data)
    mean = np.array([r["m"] for r in A.column_mean(A.centroid_residual(v)).select("pos", F.col("mean").alias("m")).orderBy("pos").collect()])
    assert np.abs(mean).max() < 1e-9
    sizes = A.cluster_sizes(N.assign(v, data[:4].astype(float)), 6).orderBy("cid").collect()
    assert [r["cid"] for r in sizes] == list(range(6)) and sum(r["n"] for r in sizes) == 1000 and sizes[5]["n"] == 0


def test_samples(spark, data):
    v = frame(spark, data)
    a = [r["vec_id"] for r in S.sample_rows(v, 100, seed=1).collect()]
    assert len(set(a)) == 100 and a == [r["vec_id"] for r in S.sample_rows(v, 100, seed=1).collect()]
    assert a != [r["vec_id"] for r in S.sample_rows(v, 100, seed=2).collect()]
    with pytest.raises(ValueError):
        S.sample_rows(v, 1001)
    assert S.training_rows(v, 2, 1000, most=100).count() == 200
    assert S.auto_k(1000) == 25 and S.auto_k(10**6) == 4000
    with pytest.raises(ValueError):
        S.auto_k(38)


def test_large_samples_are_exact(spark, monkeypatch):
    many = spark.range(1_500_000).select(F.col("id").alias("vec_id"))
    assert S.training_rows(many, 4400, 1_500_000, most=250).agg(F.count("*"), F.count_distinct("vec_id")).first()[:] == (1_100_000, 1_100_000)
    some = spark.range(1000).select(F.col("id").alias("vec_id"))
    small = {r[0] for r in S.sample_rows(some, 300, seed=3).collect()}
    monkeypatch.setattr(S, "SORTED", 2)
    assert {r[0] for r in S.sample_rows(some, 300, seed=3).collect()} == small
    # Rows of one key have one hash, so the last ones are cut among them.
    tied = some.withColumn("vec_id", F.col("vec_id") % 3)
    assert S.sample_rows(tied, 500).count() == 500


def test_centroids_beyond_one_broadcast(spark, data, monkeypatch):
    v = frame(spark, data)
    seeds = data[:10].astype(np.float64)
    whole = M.KMeans(10, 4, init=seeds).fit(v)
    close = M.KMeans(10, 4, init=seeds, approximate_from=0).fit(v)
    near = labels(R.rabitq_assign(v, whole.centroids))
    monkeypatch.setattr(M, "GATHERED_BYTES", 0)
    monkeypatch.setattr(M.K, "centroid_blocks", lambda c, limit=0: [(at, c[at : at + 3]) for at in range(0, len(c), 3)])
    assert np.allclose(M.KMeans(10, 4, init=seeds).fit(v).centroids, whole.centroids)
    assert np.abs(M.KMeans(10, 4, init=seeds, approximate_from=0).fit(v).centroids - close.centroids).max() < 0.2
    assert np.mean(np.array(labels(R.rabitq_assign(v, whole.centroids))) == near) > 0.98


def test_frozen_centroids_stay(spark, data):
    v = frame(spark, data)
    before = M.KMeans(6, 5).fit(v).centroids
    for metric, residual in (("l2", False), ("l2", True), ("ip", False)):
        model = M.KMeans(9, 5, metric=metric, use_residual=residual, frozen_centroids=before, update_index=True, approximate_from=0).fit(v)
        held = model.centroids[:6] + (model.mean if residual else 0)
        assert np.allclose(held, before) and model.centroids.shape == (9, 32)
    far = np.full((1, 32), 1e6)
    assert np.array_equal(M.KMeans(5, 3, frozen_centroids=far).fit(v).centroids[:1], far)
    for bad in (np.zeros((3, 31)), np.zeros((11, 32))):
        with pytest.raises(ValueError):
            M.KMeans(10, 3, frozen_centroids=bad).fit(v)


def test_hierarchical_clusters_lie_within_their_own(spark, data, monkeypatch):
    v = frame(spark, data)
    found = M.hierarchical(v, 3, 4, max_iter=5, min_points=1, init="first")
    top = M.KMeans(3, 5, min_points=1, init="first").fit(v)
    own = np.array(labels(top.transform(v)))
    parts = []
    for p in range(3):
        x = data[own == p].astype(np.float64)
        c = x[:4].copy()
        for _ in range(5):
            near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            c = np.stack([x[near == i].mean(0) for i in range(4)])
        parts.append(c)
    assert np.allclose(found, np.concatenate(parts))
    monkeypatch.setattr(M.K, "BROADCAST_BYTES", 4 * 32 * 8)  # one upper cluster at a time
    capped = M.hierarchical(v, 3, 4, max_iter=5, min_points=1, max_points=20)
    assert capped.shape == (12, 32) and np.isfinite(capped).all()


def test_variants(spark, data):
    v = frame(spark, data)
    assert M.mini_batch(v, 5, 4).iterations == 4
    assert M.hierarchical(v, 3, 4, max_iter=3).shape[1] == 32
    once, twice = M.KMeans(10, 3).fit(v), M.KMeans(10, 3, redo=3).fit(v)
    assert twice.history[-1] <= once.history[-1]
    whole = M.KMeans(5, 3, int_centroids=True).fit(frame(spark, np.round(data * 100))).centroids
    assert np.array_equal(whole, np.rint(whole))


def test_progressive_clustering_keeps_its_quality(spark, data):
    v = frame(spark, data)
    grown = A.inertia(N.assign(v, M.progressive(v, 8, steps=4, iterations=5))).first()["value"]
    plain = A.inertia(N.assign(v, M.KMeans(8, 20).fit(v).centroids)).first()["value"]
    assert grown < 1.1 * plain


def test_numpy_api(spark, data):
    c = Clusterer(spark)
    centroids = c.fit(data, 10)
    assert centroids.shape == (10, 32)
    exact = [int(np.argmin(np.linalg.norm(centroids - x, axis=1))) for x in data]
    assert c.assign(data[5], centroids) == exact[5]
    assert np.mean(np.array(c.batch_assign(data, centroids)) == np.array(exact)) > 0.99
    with pytest.raises(ValueError):
        c.assign(data[0][:5], centroids)
