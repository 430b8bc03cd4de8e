"""Vector functions as Column expressions, and under the same names in SQL.

Vectors are ``ARRAY<FLOAT>`` or ``ARRAY<DOUBLE>`` columns; arithmetic is in
double precision.  Nulls give null.  Bit words are 64-bit numbers, bit i % 64 of
word i / 64 for element i.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Levels of the scalar quantizer are 0 to 15, in four bits.
BITS = 4
LEVELS = 15


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x: Column | str) -> Column:
    """The vector in double precision."""
    return _col(x).cast("array<double>")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def squared_euclidean(a: Column | str, b: Column | str) -> Column:
    """Sum of squared differences."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def dot_product(a: Column | str, b: Column | str) -> Column:
    """Sum of products (positive)."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def neg_dot_product(a: Column | str, b: Column | str) -> Column:
    """The dot product as a distance: smaller is nearer."""
    return -dot_product(a, b)


def l2_norm(a: Column | str) -> Column:
    """Euclidean norm."""
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def argmin(a: Column | str) -> Column:
    """Position (from 0) of the smallest element, the first of equals; NaN is larger than any number."""
    return F.array_min(F.transform(doubles(a), lambda x, i: F.struct(x.alias("v"), i.alias("i"))))["i"]


def normalize(a: Column | str) -> Column:
    """The vector divided by its norm; a zero vector stays zero."""
    norm = l2_norm(a)
    return F.when(norm == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / norm))


def residual(a: Column | str, b: Column | str) -> Column:
    """Elementwise difference."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def min_max_residual(a: Column | str, b: Column | str) -> Column:
    """Struct of the residual and its smallest and largest element."""
    r = residual(a, b)
    return F.struct(r.alias("residual"), F.array_min(r).alias("lo"), F.array_max(r).alias("hi"))


def pad(a: Column | str, multiple: int = 64) -> Column:
    """Zeros appended up to a multiple of ``multiple`` elements."""
    x = doubles(a)
    return F.concat(x, F.array_repeat(F.lit(0.0), F.pmod(-F.size(x), F.lit(multiple)).cast("int")))


def scalar_quantize(r: Column | str, lo: Column | str, delta: Column | str) -> Column:
    """Codes 0 to 15 of the elements, ``rint((x - lo) / delta)``; all 0 where delta is 0."""
    lo, delta = _col(lo), _col(delta)
    return F.when(delta == 0, F.transform(doubles(r), lambda x: F.lit(0))).otherwise(F.transform(doubles(r), lambda x: F.rint((x - lo) / delta).cast("int")))


def _words(flags: Column) -> Column:
    """64-bit words of an array of 0 and 1 whose length is a multiple of 64."""
    word = lambda w: F.aggregate(
        F.slice(F.transform(flags, lambda f, i: F.struct(f.cast("long").alias("f"), (i % 64).alias("i"))), w * 64 + 1, F.lit(64)),
        F.lit(0).cast("long"),
        lambda s, v: s.bitwiseOR(F.call_function("shiftleft", v["f"], v["i"])),
    )
    return F.transform(F.sequence(F.lit(0), (F.size(flags) / 64).cast("int") - 1), word)


def sign_bits(a: Column | str) -> Column:
    """Bit words with a one for each element above zero; the vector is padded to a multiple of 64."""
    return _words(F.transform(pad(a), lambda x: (x > 0).cast("int")))


def sign_vector(a: Column | str) -> Column:
    """1 for each element above zero, else -1."""
    return F.transform(doubles(a), lambda x: F.when(x > 0, 1).otherwise(-1))


def bit_planes(codes: Column | str) -> Column:
    """Four arrays of bit words: plane j holds bit j of each code."""
    plane = lambda j: _words(F.transform(_col(codes), lambda c: F.shiftright(c, j).bitwiseAND(F.lit(1))))
    return F.array(*[plane(j) for j in range(BITS)])


def binary_dot(x: Column | str, y: Column | str) -> Column:
    """Number of ones that two arrays of bit words share."""
    return F.aggregate(F.zip_with(_col(x), _col(y), lambda a, b: F.bit_count(a.bitwiseAND(b)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)


def asymmetric_binary_dot(x: Column | str, planes: Column | str) -> Column:
    """Dot product of bits with four-bit codes given as planes."""
    return sum((F.call_function("shiftleft", binary_dot(x, _col(planes)[j]), F.lit(j)) for j in range(BITS)), F.lit(0).cast("long"))


_ONE, _TWO = "a ARRAY<DOUBLE>", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
#: (name, parameters, result, expression) of the functions that SQL gets.
SQL_FUNCTIONS = [
    ("squared_euclidean", _TWO, "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v)"),
    ("dot_product", _TWO, "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"),
    ("neg_dot_product", _TWO, "DOUBLE", "-aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"),
    ("l2_norm", _ONE, "DOUBLE", "sqrt(aggregate(transform(a, x -> x * x), 0D, (s, v) -> s + v))"),
    ("vector_argmin", _ONE, "INT", "array_min(transform(a, (x, i) -> struct(x, i))).i"),
    ("residual", _TWO, "ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> x - y)"),
    ("sign_vector", _ONE, "ARRAY<INT>", "transform(a, x -> if(x > 0, 1, -1))"),
    ("pad64", _ONE, "ARRAY<DOUBLE>", "concat(a, array_repeat(0D, cast(pmod(-size(a), 64) as int)))"),
    ("binary_dot", "x ARRAY<BIGINT>, y ARRAY<BIGINT>", "BIGINT", "aggregate(zip_with(x, y, (a, b) -> cast(bit_count(a & b) as bigint)), 0L, (s, v) -> s + v)"),
]


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the vector functions as temporary SQL functions; Catalyst inlines their expressions."""
    for name, parameters, result, expression in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {expression}")
    return [f[0] for f in SQL_FUNCTIONS]
