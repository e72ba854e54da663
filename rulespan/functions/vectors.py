"""Distances and utilities over array<float>. Distances are worked out in double precision.

Vectors of different length: distances are infinite, dot is 0, sums are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import takes

ZERO = 0.0
FAR = float("inf")


def total(values: Column, start: float | int = ZERO) -> Column:
    return F.aggregate(values, F.lit(start), lambda s, x: s + x)


def once(value: Column, use) -> Column:
    """use(value) with the value worked out once: inside a lambda over elements it would be again for each."""
    return F.transform(F.array(value), use)[0]


def products(a: Column, b: Column, kind: str = "double") -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast(kind) * y.cast(kind)), 0.0 if kind == "double" else 0)


def squares(a: Column, kind: str = "double") -> Column:
    return total(F.transform(a, lambda x: x.cast(kind) * x.cast(kind)), 0.0 if kind == "double" else 0)


def same(a: Column, b: Column, value: Column, other: float) -> Column:
    """value if both are given and equally long, `other` if not equally long."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) == F.size(b), value).otherwise(F.lit(other))


def euclidean(a: Column, b: Column) -> Column:
    return same(a, b, F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))), FAR)


def manhattan(a: Column, b: Column) -> Column:
    return same(a, b, total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))), FAR)


def dot(a: Column, b: Column) -> Column:
    return same(a, b, products(a, b), 0.0)


def cosine_distance(a: Column, b: Column, of_zero: float) -> Column:
    """1 - cosine, kept in [0, 2]; of_zero where a vector has no length."""
    scale = F.sqrt(squares(a)) * F.sqrt(squares(b))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), products(a, b) / F.when(scale > 0, scale)))
    return same(a, b, F.when(scale > 0, 1 - cos).otherwise(F.lit(of_zero)), FAR)


takes("vec vec", "double", "euclidean")(euclidean)
takes("vec vec", "double", "cosine")(lambda a, b: cosine_distance(a, b, 0.0))
takes("vec vec", "double", "dot")(dot)
takes("vec vec", "double", "manhattan")(manhattan)
takes("long long", "long", "hamming")(lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("bigint"))
takes("vec", "long", "vec_dim")(lambda v: F.size(v).cast("bigint"))
takes("vec8", "long", "vec_dim_int8")(lambda v: F.size(v).cast("bigint"))
takes("vec vec", "vec", "vec_add")(lambda a, b: F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: (x + y).cast("float"))))
takes("vec num", "vec", "vec_scale")(lambda v, s: F.transform(v, lambda x: (x * s.cast("float")).cast("float")))


@takes("vec", "vec", "normalize")
def normalize(v: Column) -> Column:
    return once(F.sqrt(squares(v)), lambda norm: F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v))
