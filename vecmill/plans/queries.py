"""Registered queries of the vector operators over ``embeddings``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import aggregate as A
from ..operators import assign as N
from ..operators import kmeans as M
from ..operators import rabitq as R
from ..operators import reshape as H
from ..operators import sampling as S
from ..sources import generate as G
from ..sources import vecs as X
from .session import delete_at_end, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

#: Clusters of the queries, their iterations, neighbours of a search and dimensions of reshaped rows.
KC, ITERATIONS, NEIGHBOURS, WIDTH, DIM = 10, 5, 5, 16, 64
_SEED = 7

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def _seeds(v: DataFrame) -> DataFrame:
    """The first vectors as centroids."""
    return v.where(F.col("vec_id") < KC).select(F.col("vec_id").cast("int").alias("cid"), F.col("embedding").cast("array<double>").alias("centroid"))


def _matrix(centroids: DataFrame) -> np.ndarray:
    return np.array([r["centroid"] for r in centroids.orderBy("cid").collect()])


def _long(rows: DataFrame, key: str, vector: str) -> DataFrame:
    flat = H.flatten(rows, key, vector)
    return flat.select(key, "pos", F.round("value", 6).alias("value"))


def _centroid_rows(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    rows = [(c, p, float(x)) for c, row in enumerate(centroids) for p, x in enumerate(row)]
    return spark.createDataFrame(rows, "cid int, pos int, value double").select("cid", "pos", F.round("value", 6).alias("value"))


# SQL pieces. A sum is a left fold, as in Spark; adding 0.0 to a rounded number removes a negative zero.


def _fold(terms: str) -> str:
    return f"list_reduce(list_prepend(0::DOUBLE, {terms}), lambda s, t: s + t)"


def _zip(a: str, b: str, cell: str) -> str:
    return _fold(f"list_transform(list_zip({a}, {b}), lambda z: {cell})")


def _l2(a: str, b: str) -> str:
    return _zip(a, b, "(z[1] - z[2]) * (z[1] - z[2])")


def _ip(a: str, b: str) -> str:
    return _zip(a, b, "z[1] * z[2]")


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
_C = f"c AS (SELECT vec_id::INTEGER AS cid, e FROM v WHERE vec_id < {KC})"
_WITH = f"WITH {_V}, {_C}"
_NORM = f"sqrt({_fold('list_transform(e, lambda x: x * x)')})"
_CELLS = "SELECT vec_id, (unnest(range(1, len(e) + 1)) - 1)::INTEGER AS pos, unnest(e) AS x FROM v"
_MEAN = f"m AS (SELECT list(mean ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS mean FROM ({_CELLS}) GROUP BY pos))"
_ASSIGNED = f"a AS MATERIALIZED (SELECT vec_id, arg_min(cid, {{'d': d, 'cid': cid}}) AS label, min(d) AS distance FROM (SELECT vec_id, cid, {_l2('v.e', 'c.e')} AS d FROM v, c) GROUP BY vec_id)"


def _pairs(value: str) -> str:
    return f"{_WITH} SELECT vec_id, cid, {_r(value)} AS value FROM v, c"


@_query(_pairs(_l2("v.e", "c.e")))
def q_sq_euclidean(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return N.pairwise(v, _seeds(v), lambda a, b: F.round(V.squared_euclidean(a, b), 6))


@_query(_pairs(_ip("v.e", "c.e")))
def q_dot_product(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return N.pairwise(v, _seeds(v), lambda a, b: F.round(V.dot_product(a, b), 6))


@_query(_pairs("-" + _ip("v.e", "c.e")))
def q_neg_dot(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return N.pairwise(v, _seeds(v), lambda a, b: F.round(V.neg_dot_product(a, b), 6))


@_query(f"WITH {_V} SELECT vec_id, {_r(_NORM)} AS norm FROM v")
def q_l2_norm(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(V.l2_norm("embedding"), 6).alias("norm"))


@_query(f"WITH {_V} SELECT vec_id, (list_position(e, list_min(e)) - 1)::INTEGER AS pos FROM v")
def q_argmin(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", V.argmin("embedding").alias("pos"))


@_query(f"WITH {_V}, n AS (SELECT vec_id, list_transform(e, lambda x: x / {_NORM}) AS u FROM v) SELECT vec_id, (unnest(range(1, len(u) + 1)) - 1)::INTEGER AS pos, {_r('unnest(u)')} AS value FROM n")
def q_normalize(spark, sf_dir):
    return _long(_vectors(spark, sf_dir).select("vec_id", V.normalize("embedding").alias("u")), "vec_id", "u")


@_query(f"WITH {_V} SELECT pos, {_r('avg(x)')} AS mean FROM ({_CELLS}) GROUP BY pos")
def q_column_mean(spark, sf_dir):
    return A.column_mean(_vectors(spark, sf_dir)).select("pos", F.round("mean", 6).alias("mean"))


@_query(f"WITH {_V}, {_MEAN} SELECT vec_id, pos, {_r('x - mean[pos + 1]')} AS value FROM ({_CELLS}), m")
def q_centroid_residual(spark, sf_dir):
    return _long(A.centroid_residual(_vectors(spark, sf_dir)), "vec_id", "embedding")


@_query(f"WITH {_V}, {_MEAN}, d AS (SELECT vec_id, list_transform(list_zip(e, mean), lambda z: z[1] - z[2]) AS r FROM v, m) SELECT vec_id, {_r('list_min(r)')} AS lo, {_r('list_max(r)')} AS hi FROM d")
def q_min_max_residual(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    rows = v.join(F.broadcast(A.mean_vector(v))).select("vec_id", V.min_max_residual("embedding", "mean").alias("m"))
    return rows.select("vec_id", F.round("m.lo", 6).alias("lo"), F.round("m.hi", 6).alias("hi"))


@_query(f"WITH {_V} SELECT vec_id, pos, x AS value FROM ({_CELLS})")
def q_flatten(spark, sf_dir):
    return H.flatten(_vectors(spark, sf_dir), "vec_id", "embedding")


@_query(f"WITH {_V} SELECT vec_id, (pos // {WIDTH})::INTEGER AS row, (pos % {WIDTH})::INTEGER AS pos, x AS value FROM ({_CELLS})")
def q_reshape(spark, sf_dir):
    rows = H.reshape(H.flatten(_vectors(spark, sf_dir), "vec_id", "embedding"), "vec_id", WIDTH)
    return rows.select("vec_id", "row", F.posexplode("vector").alias("pos", "value"))


_CUT = 50


@_query(f"WITH {_V}, p AS (SELECT vec_id, list_concat(e[1:{_CUT}], list_transform(range({DIM - _CUT}), lambda i: 0::DOUBLE)) AS u FROM v) SELECT vec_id, (unnest(range(1, {DIM + 1})) - 1)::INTEGER AS pos, unnest(u) AS value FROM p")
def q_pad64(spark, sf_dir):
    return H.flatten(_vectors(spark, sf_dir).select("vec_id", V.pad(F.slice("embedding", 1, _CUT)).alias("u")), "vec_id", "u")


@_query(f"{_WITH}, {_ASSIGNED} SELECT vec_id, label FROM a")
def q_assign_l2(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return N.assign(v, _matrix(_seeds(v))).select("vec_id", "label")


@_query(f"{_WITH} SELECT vec_id, arg_min(cid, {{'d': d, 'cid': cid}}) AS label FROM (SELECT vec_id, cid, -{_ip('v.e', 'c.e')} AS d FROM v, c) GROUP BY vec_id")
def q_assign_ip(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return N.assign(v, _matrix(_seeds(v)), "ip").select("vec_id", "label")


@_query(f"{_WITH}, {_ASSIGNED} SELECT vec_id, label, {_r('distance')} AS distance FROM a")
def q_assign_join(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return N.assign_join(v, _seeds(v)).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@_query(f"{_WITH}, q AS (SELECT e FROM v WHERE vec_id = {KC}) SELECT cid AS label, {_r('d')} AS distance FROM (SELECT cid, {_l2('c.e', 'q.e')} AS d FROM c, q) ORDER BY d, cid LIMIT 1")
def q_assign_single(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    one = v.where(F.col("vec_id") == KC).first()["embedding"]
    return N.assign_single(_seeds(v), one).select("label", F.round("distance", 6).alias("distance"))


@_query(f"{_WITH}, {_ASSIGNED} SELECT cid, count(label) AS n FROM c LEFT JOIN a ON label = cid GROUP BY cid")
def q_cluster_sizes(spark, sf_dir):
    return A.cluster_sizes(q_assign_l2(spark, sf_dir), KC).select("cid", F.col("n").cast("long").alias("n"))


_MEANS = f"u AS (SELECT label AS cid, pos, avg(x) AS value FROM ({_CELLS}) JOIN a USING (vec_id) GROUP BY label, pos)"


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    kept = v.withColumn("x", F.col("embedding"))
    return A.cluster_means(N.assign(kept, _matrix(_seeds(v))), vector="x")


@_query(f"{_WITH}, {_ASSIGNED}, {_MEANS} SELECT cid, pos, {_r('value')} AS value FROM u")
def q_update_centroids(spark, sf_dir):
    return _means(spark, sf_dir).select("cid", "pos", F.round("value", 6).alias("value"))


@_query(f"{_WITH}, {_ASSIGNED}, {_MEANS} SELECT {_r('sum((x - value) * (x - value))')} AS value FROM u JOIN (SELECT vec_id AS cid, pos, x FROM ({_CELLS})) USING (cid, pos)")
def q_centroid_shift(spark, sf_dir):
    old = H.flatten(_seeds(_vectors(spark, sf_dir)), "cid", "centroid")
    return A.centroid_shift(old, _means(spark, sf_dir)).select(F.round("value", 6).alias("value"))


@_query(f"{_WITH}, {_ASSIGNED} SELECT {_r('sum(distance)')} AS value FROM a")
def q_inertia(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return A.inertia(N.assign(v, _matrix(_seeds(v)))).select(F.round("value", 6).alias("value"))


@_query(
    f"""{_WITH}, f AS (SELECT cid, CASE WHEN cid = {KC - 1} THEN list_transform(e, lambda x: 1000::DOUBLE) ELSE e END AS e FROM c),
{_ASSIGNED.replace(_l2("v.e", "c.e"), _l2("v.e", "f.e")).replace("FROM v, c", "FROM v, f")}, {_MEANS}, n AS (SELECT label AS cid, count(*) AS n FROM a GROUP BY label),
d AS (SELECT min(cid) AS donor FROM n WHERE n >= 2)
SELECT cid, pos, {_r(f"CASE WHEN cid = donor THEN value * CASE WHEN pos % 2 = 0 THEN {1 - A.EPS!r}::DOUBLE ELSE {1 + A.EPS!r}::DOUBLE END ELSE value END")} AS value FROM u, d
UNION ALL SELECT {KC - 1}, pos, {_r(f"value * CASE WHEN pos % 2 = 0 THEN {1 + A.EPS!r}::DOUBLE ELSE {1 - A.EPS!r}::DOUBLE END")} FROM u, d WHERE cid = donor"""
)
def q_split_empty(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    centroids = _matrix(_seeds(v))
    centroids[KC - 1] = 1000.0
    sizes, sums, _ = M.cluster_sums(v, centroids, "l2", vector="embedding")
    means = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return _centroid_rows(spark, A.split_empty(means, sizes)[0])


def _sample_sql(n: str) -> str:
    return f"SELECT vec_id FROM embeddings ORDER BY md5(vec_id || ':{_SEED}'), vec_id LIMIT {n}"


@_query(_sample_sql("100"))
def q_sample_n(spark, sf_dir):
    return S.sample_rows(_vectors(spark, sf_dir), 100, seed=_SEED).select("vec_id")


@_query(_sample_sql(str(S.MAX_POINTS)))
def q_subsample_cap(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return S.training_rows(v, 1, v.count(), seed=_SEED).select("vec_id")


@_query(_sample_sql(str(KC)))
def q_seed_centroids(spark, sf_dir):
    return S.seed_rows(_vectors(spark, sf_dir), KC, seed=_SEED).select("vec_id")


@_query(f"SELECT count(*) AS n, least(floor(sqrt(count(*)))::BIGINT * 4, count(*) // {S.MIN_POINTS})::INTEGER AS k FROM embeddings")
def q_auto_k(spark, sf_dir):
    n = _vectors(spark, sf_dir).count()
    return spark.createDataFrame([(n, S.auto_k(n))], "n long, k int")


def _lloyd_sql(metric: str, residual: bool, labels: bool) -> str:
    """ITERATIONS unrolled iterations from the first vectors."""
    distance = _l2 if metric == "l2" else (lambda a, b: "-" + _ip(a, b))
    norm = (lambda e: e) if metric == "l2" else (lambda e: f"list_transform({e}, lambda x: x / sqrt({_fold(f'list_transform({e}, lambda y: y * y)')}))")
    base = "WITH v0 AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
    if residual:
        cells = "SELECT (unnest(range(1, len(e) + 1)) - 1)::INTEGER AS pos, unnest(e) AS x FROM v0"
        base += f", m AS (SELECT list(mean ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS mean FROM ({cells}) GROUP BY pos)), v AS MATERIALIZED (SELECT vec_id, list_transform(list_zip(e, mean), lambda z: z[1] - z[2]) AS e FROM v0, m)"
    else:
        base += ", v AS MATERIALIZED (SELECT * FROM v0)"
    base += f", c0 AS MATERIALIZED (SELECT vec_id::INTEGER AS cid, {norm('e')} AS e FROM v WHERE vec_id < {KC})"
    for i in range(ITERATIONS + labels):
        base += f", a{i} AS MATERIALIZED (SELECT vec_id, arg_min(cid, {{'d': d, 'cid': cid}}) AS label FROM (SELECT vec_id, cid, {distance('v.e', f'c{i}.e')} AS d FROM v, c{i}) GROUP BY vec_id)"
        if i < ITERATIONS:
            mean = f"SELECT label AS cid, list(x ORDER BY pos) AS e FROM (SELECT label, pos, avg(x) AS x FROM ({_CELLS}) JOIN a{i} USING (vec_id) GROUP BY label, pos) GROUP BY label"
            base += f", c{i + 1} AS MATERIALIZED (SELECT cid, {norm('e')} AS e FROM ({mean}))"
    if labels:
        return base + f" SELECT vec_id, label FROM a{ITERATIONS}"
    return base + f" SELECT cid, (unnest(range(1, len(e) + 1)) - 1)::INTEGER AS pos, {_r('unnest(e)')} AS value FROM c{ITERATIONS}"


def _model(spark: SparkSession, sf_dir: str, metric: str, residual: bool) -> tuple[DataFrame, M.KMeansModel]:
    v = _vectors(spark, sf_dir)
    # The cap and the early stop are off: a fixed number of iterations over all rows can be compared with SQL.
    model = M.KMeans(KC, ITERATIONS, tolerance=1e-300, metric=metric, use_residual=residual, init="first", max_points=1 << 40).fit(v)
    return v, model


def _register_kmeans() -> None:
    for name, metric, residual in (("l2", "l2", False), ("ip", "ip", False), ("residual", "l2", True)):

        def centroids(spark, sf_dir, metric=metric, residual=residual):
            return _centroid_rows(spark, _model(spark, sf_dir, metric, residual)[1].centroids)

        def labels(spark, sf_dir, metric=metric, residual=residual):
            v, model = _model(spark, sf_dir, metric, residual)
            return model.transform(v).select("vec_id", "label")

        centroids.__name__, labels.__name__ = f"q_kmeans_{name}", f"q_kmeans_{name}_labels"
        _query(_lloyd_sql(metric, residual, False))(centroids)
        _query(_lloyd_sql(metric, residual, True))(labels)


_register_kmeans()


@_query(f"{_WITH} SELECT qid, rank, vec_id FROM (SELECT cid::BIGINT AS qid, vec_id, row_number() OVER (PARTITION BY cid ORDER BY {_l2('v.e', 'c.e')}, vec_id)::INTEGER AS rank FROM v, c) WHERE rank <= {NEIGHBOURS}")
def q_knn_groundtruth(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return N.nearest_rows(_seeds(v).select(F.col("cid").cast("long").alias("qid"), F.col("centroid").alias("query")), v, NEIGHBOURS)


@_query(f"WITH {_V} SELECT vec_id, pos, CASE WHEN x > 0 THEN 1 ELSE -1 END AS value FROM ({_CELLS})")
def q_sign_vector(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(V.sign_vector("embedding")).alias("pos", "value"))


def _word(flag: str) -> str:
    """A signed 64-bit word from rows (bit, flag): the top bit counts negative."""
    return f"sum(CASE WHEN {flag} THEN CASE WHEN pos % 64 = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << (pos % 64)::HUGEINT) END ELSE 0 END)::BIGINT"


@_query(f"WITH {_V} SELECT vec_id, (pos // 64)::INTEGER AS word, {_word('x > 0')} AS value FROM ({_CELLS}) GROUP BY vec_id, pos // 64")
def q_sign_bits(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(V.sign_bits("embedding")).alias("word", "value"))


_QUANT = f"""q AS (SELECT vec_id, e, list_min(e) AS lo, (list_max(e) - list_min(e)) / 15 AS delta FROM v),
k AS (SELECT vec_id, (unnest(range(1, len(e) + 1)) - 1)::INTEGER AS pos, CASE WHEN delta = 0 THEN 0 ELSE round_even((unnest(e) - lo) / delta, 0) END::INTEGER AS code FROM q)"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", V.doubles("embedding").alias("e")).withColumn("lo", F.array_min("e")).withColumn("delta", (F.array_max("e") - F.col("lo")) / 15.0)
    return rows.select("vec_id", "e", V.scalar_quantize("e", "lo", "delta").alias("codes"))


@_query(f"WITH {_V}, {_QUANT} SELECT vec_id, pos, code, (sum(code) OVER (PARTITION BY vec_id))::BIGINT AS total FROM k")
def q_scalar_quantize(spark, sf_dir):
    rows = _codes(spark, sf_dir)
    total = F.aggregate("codes", F.lit(0), lambda s, x: s + x).cast("long").alias("total")
    return rows.select("vec_id", total, F.posexplode("codes").alias("pos", "code")).select("vec_id", "pos", "code", "total")


_PLANES = " UNION ALL ".join(f"SELECT vec_id, {j} AS plane, (pos // 64)::INTEGER AS word, {_word(f'(code >> {j}) & 1 = 1')} AS value FROM k GROUP BY vec_id, pos // 64" for j in range(4))


@_query(f"WITH {_V}, {_QUANT} {_PLANES}")
def q_bit_planes(spark, sf_dir):
    rows = _codes(spark, sf_dir).select("vec_id", F.posexplode(V.bit_planes("codes")).alias("plane", "w"))
    return rows.select("vec_id", "plane", F.posexplode("w").alias("word", "value"))


@_query(f"{_WITH} SELECT v.vec_id, cid, list_sum(list_transform(list_zip(v.e, c.e), lambda z: CASE WHEN z[1] > 0 AND z[2] > 0 THEN 1 ELSE 0 END))::BIGINT AS value FROM v, c")
def q_binary_dot(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    bits = v.select("vec_id", V.sign_bits("embedding").alias("embedding"))
    return N.pairwise(bits, _seeds(v).select("cid", V.sign_bits("centroid").alias("centroid")), V.binary_dot)


@_query(f"{_WITH}, {_QUANT}, l AS (SELECT vec_id, list(code ORDER BY pos) AS codes FROM k GROUP BY vec_id) SELECT l.vec_id, cid, list_sum(list_transform(list_zip(l.codes, c.e), lambda z: CASE WHEN z[2] > 0 THEN z[1] ELSE 0 END))::BIGINT AS value FROM l, c")
def q_asym_binary_dot(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    planes = _codes(spark, sf_dir).select("vec_id", V.bit_planes("codes").alias("embedding"))
    return N.pairwise(planes, _seeds(v).select("cid", V.sign_bits("centroid").alias("centroid")), lambda p, b: V.asymmetric_binary_dot(b, p))


def _turned(e: str) -> str:
    """Rotation by a Hadamard block."""
    cell = _fold(f"list_transform(range({DIM}), lambda i: {e}[i + 1] * CASE WHEN bit_count(i & j) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / 8)")
    return f"list_transform(range({DIM}), lambda j: {cell})"


_D = float(DIM)
_INDEX = f"""pc AS MATERIALIZED (SELECT cid, e, {_turned("e")} AS p FROM c),
pm AS MATERIALIZED (SELECT list(x ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS x FROM (SELECT (unnest(range(1, {DIM + 1})) - 1)::INTEGER AS pos, unnest(p) AS x FROM pc) GROUP BY pos)),
xc AS MATERIALIZED (SELECT cid, e, list_transform(list_zip(p, m), lambda z: z[1] - z[2]) AS x FROM pc, pm),
xr AS MATERIALIZED (SELECT *, sqrt({_fold("list_transform(x, lambda y: y * y)")}) AS r, list_transform(x, lambda y: CASE WHEN y > 0 THEN 1 ELSE -1 END) AS s FROM xc),
xi AS (SELECT *, r / CASE WHEN r * 8 > 2.2250738585072014e-308 THEN {_zip("x", "s", "z[1] * z[2]")} / (r * 8) ELSE 0.8 END AS ratio FROM xr),
f AS MATERIALIZED (SELECT cid, e, s, (row_number() OVER (ORDER BY r, cid) - 1)::INTEGER AS slot, r * r AS cds, -0.25::DOUBLE * ratio AS ip,
  -0.25::DOUBLE * ratio * list_sum(s) AS ppc, {2 * R.EPSILON / (_D - 1) ** 0.5!r}::DOUBLE * sqrt(greatest(ratio * ratio - r * r, 0)) AS bound FROM xi)"""


@_query(f"WITH {_V}, t AS (SELECT vec_id, {_turned('e')} AS p FROM v) SELECT vec_id, (unnest(range(1, {DIM + 1})) - 1)::INTEGER AS pos, {_r('unnest(p)')} AS value FROM t")
def q_project(spark, sf_dir):
    return _long(_vectors(spark, sf_dir).select("vec_id", R.project("embedding", DIM).alias("p")), "vec_id", "p")


@_query(f"{_WITH}, {_INDEX} SELECT cid, (unnest(range(1, {DIM + 1})) - 1)::INTEGER AS pos, {_r('unnest(x)')} AS value FROM xc")
def q_rabitq_center(spark, sf_dir):
    return _long(R.centred_centroids(_seeds(_vectors(spark, sf_dir)), DIM), "cid", "centred")


@_query(f"{_WITH}, {_INDEX} SELECT cid, {_r('cds')} AS center_distance_square, {_r('ip')} AS factor_ip, {_r('ppc')} AS factor_ppc, {_r('bound')} AS error_bound FROM f")
def q_rabitq_factors(spark, sf_dir):
    rows = R.factors(_seeds(_vectors(spark, sf_dir)), DIM)
    return rows.select("cid", *[F.round(c, 6).alias(c) for c in ("center_distance_square", "factor_ip", "factor_ppc", "error_bound")])


@_query(f"{_WITH}, {_INDEX} SELECT cid, (unnest(range(1, 5)) - 1)::INTEGER AS pos, {_r('unnest([ip, ppc, bound, cds])')} AS value FROM f")
def q_factor_array(spark, sf_dir):
    index = R.factors(_seeds(_vectors(spark, sf_dir)), DIM)
    return _long(R.factor_array(R.factor_columns(R.factor_array(index))), "cid", "factors")


@_query(f"{_WITH}, {_INDEX} SELECT cid, slot FROM f")
def q_rabitq_slots(spark, sf_dir):
    return R.factors(_seeds(_vectors(spark, sf_dir)), DIM).select("cid", "slot")


_ROUGH = f"""pv AS MATERIALIZED (SELECT vec_id, e, {_turned("e")} AS p FROM v),
rv AS MATERIALIZED (SELECT vec_id, e, list_transform(list_zip(p, m), lambda z: z[1] - z[2]) AS r FROM pv, pm),
dv AS (SELECT *, {_fold("list_transform(r, lambda y: y * y)")} AS sq, list_min(r) AS lo, (list_max(r) - list_min(r)) / 15 AS delta FROM rv),
qv AS MATERIALIZED (SELECT *, list_transform(r, lambda y: CASE WHEN delta = 0 THEN 0 ELSE round_even((y - lo) / delta, 0) END::INTEGER) AS codes FROM dv),
rough AS MATERIALIZED (SELECT vec_id, cid, slot, {_l2("qv.e", "f.e")} AS d, cds + sq + lo * ppc + (2 * list_sum(list_transform(list_zip(codes, s), lambda z: CASE WHEN z[2] > 0 THEN z[1] ELSE 0 END)) - list_sum(codes)) * ip * delta - bound * sqrt(sq) AS rough FROM qv, f)"""


@_query(f"{_WITH}, {_INDEX}, {_ROUGH} SELECT vec_id, cid, {_r('rough')} AS rough FROM rough")
def q_rabitq_rough(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    turned = _seeds(v).select("cid", R.project("centroid", DIM).alias("p"))
    codes = R.quantized(v, A.mean_vector(turned, "p"), DIM)
    return R.rough_distances(codes, R.factors(_seeds(v), DIM)).select("vec_id", "cid", F.round("rough", 6).alias("rough"))


_SCAN = f"""scan AS MATERIALIZED (SELECT vec_id, list_reduce(list_prepend({{'slot': -1, 'cid': 0, 'd': 0::DOUBLE, 'rough': 0::DOUBLE, 'best': 1e300::DOUBLE, 'label': 0, 'n': 0}},
  list({{'slot': slot, 'cid': cid, 'd': d, 'rough': rough, 'best': 0::DOUBLE, 'label': 0, 'n': 0}} ORDER BY slot)),
  lambda s, z: {{'slot': z.slot, 'cid': z.cid, 'd': z.d, 'rough': z.rough, 'best': CASE WHEN z.rough < s.best AND z.d < s.best THEN z.d ELSE s.best END,
  'label': CASE WHEN z.rough < s.best AND z.d < s.best THEN z.cid ELSE s.label END, 'n': s.n + CASE WHEN z.rough < s.best THEN 1 ELSE 0 END}}) AS s FROM rough GROUP BY vec_id)"""


def _quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return R.rabitq_assign(v, _matrix(_seeds(v)), "hadamard")


@_query(f"{_WITH}, {_INDEX}, {_ROUGH}, {_SCAN} SELECT vec_id, s.label AS label FROM scan")
def q_rabitq_assign(spark, sf_dir):
    return _quantised(spark, sf_dir).select("vec_id", "label")


@_query(f"{_WITH}, {_INDEX}, {_ROUGH}, {_SCAN} SELECT (count(*) * {KC})::BIGINT AS rough, sum(s.n)::BIGINT AS precise FROM scan")
def q_rabitq_metrics(spark, sf_dir):
    return R.metrics(_quantised(spark, sf_dir), KC)


@_query(f"{_WITH}, {_INDEX}, {_ROUGH}, {_SCAN}, {_ASSIGNED} SELECT count(*) AS n, count(*) FILTER (s.label = a.label) AS same, avg(CASE WHEN s.label = a.label THEN 1.0 ELSE 0.0 END) >= 0.99 AS enough FROM scan JOIN a USING (vec_id)")
def q_rabitq_match_rate(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    exact = N.assign(v, _matrix(_seeds(v))).select("vec_id", F.col("label").alias("exact"))
    same = F.col("label") == F.col("exact")
    both = _quantised(spark, sf_dir).select("vec_id", "label").join(exact, "vec_id")
    return both.agg(F.count("*").alias("n"), F.count(F.when(same, 1)).alias("same"), (F.avg(same.cast("double")) >= 0.99).alias("enough"))


@_query(f"WITH {_V} SELECT vec_id, pos, x AS value FROM ({_CELLS})")
def q_vecs_roundtrip(spark, sf_dir):
    """Through fvecs files in the shared folder and back."""
    folder = shared_folder(spark)
    path = f"{folder.rstrip('/')}/roundtrip-{np.random.default_rng().integers(1 << 60):x}.fvecs"
    X.write_vecs(_vectors(spark, sf_dir), path)
    delete_at_end(spark, path)
    return X.read_vecs(spark, path).select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value"))


@_query("SELECT i AS vec_id, p::INTEGER AS pos, ('0x' || substr(md5('0:' || i || ':' || p), 1, 2))::INTEGER::DOUBLE AS value FROM range(1000) AS r(i), range(100) AS d(p)")
def q_generate_random(spark, sf_dir):
    return H.flatten(G.random_vectors(spark, 1000, 100), "vec_id", "embedding")


def _mini_batch_sql(batches: int = 10) -> str:
    draw = f"('0x' || substr(md5(vec_id || ':0'), 1, 8))::BIGINT % {batches}"
    out = f"WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e, {draw} AS part FROM embeddings)"
    out += f", c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY md5(vec_id || ':0'), vec_id) - 1)::INTEGER AS cid, e, 0::DOUBLE AS seen FROM v ORDER BY md5(vec_id || ':0'), vec_id LIMIT {KC})"
    for i in range(batches):
        out += f", a{i} AS MATERIALIZED (SELECT vec_id, arg_min(cid, {{'d': d, 'cid': cid}}) AS label FROM (SELECT vec_id, cid, {_l2('v.e', 'c.e')} AS d FROM v, c{i} AS c WHERE part = {i}) GROUP BY vec_id)"
        out += f", m{i} AS MATERIALIZED (SELECT label AS cid, max(n)::DOUBLE AS n, list(x ORDER BY pos) AS m FROM (SELECT label, pos, avg(x) AS x, count(*) AS n FROM ({_CELLS}) JOIN a{i} USING (vec_id) GROUP BY label, pos) GROUP BY label)"
        out += f""", c{i + 1} AS MATERIALIZED (SELECT cid, CASE WHEN n IS NULL THEN e ELSE list_transform(list_zip(e, m), lambda z: z[1] * (1 - n / (seen + n)) + n / (seen + n) * z[2]) END AS e,
  seen + coalesce(n, 0) AS seen FROM c{i} LEFT JOIN m{i} USING (cid))"""
    return out + f" SELECT vec_id, arg_min(cid, {{'d': d, 'cid': cid}}) AS label FROM (SELECT vec_id, cid, {_l2('v.e', 'c.e')} AS d FROM v, c{batches} AS c) GROUP BY vec_id"


@_query(_mini_batch_sql())
def q_mini_batch(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return M.mini_batch(v, KC).transform(v).select("vec_id", "label")


_TOP, _EACH = 3, 3


def _hierarchical_sql() -> str:
    """Unrolled iterations of the upper clusters, then of the lower ones, each within its upper one."""
    mean = "list(x ORDER BY pos) AS e"
    out = f"WITH {_V}, c0 AS (SELECT vec_id::INTEGER AS cid, e FROM v WHERE vec_id < {_TOP})"
    for i in range(ITERATIONS + 1):
        out += f", a{i} AS MATERIALIZED (SELECT vec_id, arg_min(cid, {{'d': d, 'cid': cid}}) AS label FROM (SELECT vec_id, cid, {_l2('v.e', 'c.e')} AS d FROM v, c{i} AS c) GROUP BY vec_id)"
        if i < ITERATIONS:
            out += f", c{i + 1} AS MATERIALIZED (SELECT label AS cid, {mean} FROM (SELECT label, pos, avg(x) AS x FROM ({_CELLS}) JOIN a{i} USING (vec_id) GROUP BY label, pos) GROUP BY label)"
    out += f", w AS MATERIALIZED (SELECT vec_id, e, label AS parent FROM v JOIN a{ITERATIONS} USING (vec_id))"
    out += f", d0 AS MATERIALIZED (SELECT parent, cid, e FROM (SELECT parent, e, row_number() OVER (PARTITION BY parent ORDER BY vec_id) - 1 AS cid FROM w) WHERE cid < {_EACH})"
    for i in range(ITERATIONS):
        out += f", b{i} AS MATERIALIZED (SELECT vec_id, parent, arg_min(cid, {{'d': d, 'cid': cid}}) AS label FROM (SELECT vec_id, w.parent, cid, {_l2('w.e', 'd.e')} AS d FROM w JOIN d{i} AS d ON d.parent = w.parent) GROUP BY vec_id, parent)"
        out += f", d{i + 1} AS MATERIALIZED (SELECT parent, label AS cid, {mean} FROM (SELECT parent, label, pos, avg(x) AS x FROM ({_CELLS}) JOIN b{i} USING (vec_id) GROUP BY parent, label, pos) GROUP BY parent, label)"
    out += f", g AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY parent, cid) - 1)::INTEGER AS cid, e FROM d{ITERATIONS})"
    return out + f" SELECT vec_id, arg_min(cid, {{'d': d, 'cid': cid}}) AS label FROM (SELECT vec_id, cid, {_l2('v.e', 'g.e')} AS d FROM v, g) GROUP BY vec_id"


@_query(_hierarchical_sql())
def q_hierarchical(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    centroids = M.hierarchical(v, _TOP, _EACH, max_iter=ITERATIONS, tolerance=1e-300, init="first", min_points=1, max_points=1 << 30)
    return N.assign(v, centroids).select("vec_id", "label")


@_query()
def q_progressive(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return N.assign(v, M.progressive(v, 3, steps=4, iterations=3)).select("vec_id", "label")
