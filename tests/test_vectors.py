"""Vector functions against NumPy on random inputs, and in SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmill.functions import vectors as V

rng = np.random.default_rng(5)


def one(spark, expression, **columns):
    kinds = {float: "array<double>", int: "array<int>"}
    schema = ", ".join(f"{n} {kinds[type(v[0])]}" for n, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize("dim", [4, 12, 64, 70, 78])
def test_distances(spark, dim):
    a, b = rng.random(dim), rng.random(dim)
    x, y = a.tolist(), b.tolist()
    assert one(spark, V.squared_euclidean("a", "b"), a=x, b=y) == pytest.approx(((a - b) ** 2).sum(), abs=1e-9)
    assert one(spark, V.dot_product("a", "b"), a=x, b=y) == pytest.approx(a @ b, abs=1e-9)
    assert one(spark, V.neg_dot_product("a", "b"), a=x, b=y) == pytest.approx(-(a @ b), abs=1e-9)
    assert one(spark, V.l2_norm("a"), a=x) == pytest.approx(np.linalg.norm(a), abs=1e-9)
    assert one(spark, V.argmin("a"), a=x) == int(a.argmin())


def test_argmin_ties_and_nan(spark):
    assert one(spark, V.argmin("a"), a=[2.0, 1.0, 1.0]) == 1
    assert one(spark, V.argmin("a"), a=[float("nan"), 3.0]) == 1


def test_normalize_zero(spark):
    assert one(spark, V.normalize("a"), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.normalize("a"), a=[3.0, 4.0]) == [0.6, 0.8]


@pytest.mark.parametrize("dim", [64, 128, 320])
def test_bits(spark, dim):
    codes, signs = rng.integers(0, 16, dim), rng.standard_normal(dim)
    pack = lambda f: [int(w) for w in np.packbits(np.asarray(f, np.uint8), bitorder="little").view(np.int64)]
    assert one(spark, V.sign_bits("a"), a=signs.tolist()) == pack(signs > 0)
    assert one(spark, V.bit_planes("q"), q=codes.tolist()) == [pack(codes >> j & 1) for j in range(4)]
    product = one(spark, V.asymmetric_binary_dot(V.sign_bits("a"), V.bit_planes("q")), a=signs.tolist(), q=codes.tolist())
    assert product == int(codes[signs > 0].sum())


def test_sign_of_zero_and_padding(spark):
    assert one(spark, V.sign_vector("a"), a=[0.0, 1.0, -1.0]) == [-1, 1, -1]
    assert len(one(spark, V.pad("a"), a=[1.0] * 70)) == 128
    assert len(one(spark, V.pad("a"), a=[1.0] * 64)) == 64


def test_quantize_constant(spark):
    row = spark.createDataFrame([([1.0, 1.0],)], "r array<double>")
    assert row.select(V.scalar_quantize("r", F.lit(1.0), F.lit(0.0)).alias("c")).first()["c"] == [0, 0]


def test_sql_functions(spark):
    assert "squared_euclidean" in V.register_sql_functions(spark)
    row = spark.sql("SELECT squared_euclidean(array(1D, 2D), array(3D, 4D)) AS d, vector_argmin(array(2D, 1D)) AS i, size(pad64(array(1D))) AS n").first()
    assert (row["d"], row["i"], row["n"]) == (8.0, 1, 64)
