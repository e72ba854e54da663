"""Locality-sensitive buckets by signs of projections on seeded hyperplanes.

Plane coordinates are hashes of (table, plane, coordinate), so buckets need no stored planes
and every function stays an expression in the JVM. Bucket numbers are this library's own;
what holds is their structure: equal vectors share a bucket, 0 <= bucket < 2**planes, and
probes come in order of Hamming distance, or of distance to the boundary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Typed, function, null

MOST = 62


def _margins(v: Column, table: Column, planes: Column) -> Column:
    """Projection of v on each plane."""
    coordinate = lambda h, i: F.xxhash64(table, h, i).cast("double") / 9.223372036854775807e18
    dots = lambda h: F.aggregate(F.transform(v, lambda x, i: x.cast("double") * coordinate(h, i)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.least(planes, F.lit(MOST)), F.lit(1)) - 1), dots)


def _bits(margins: Column) -> Column:
    """Plane h sets bit h where the projection is positive."""
    return F.aggregate(F.transform(margins, lambda m, h: F.when(m > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), h).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def _bucket(v: Column, table: Column, planes: Column) -> Column:
    return F.when(planes < 0, F.lit(None).cast("bigint")).when((F.size(v) == 0) | (planes == 0), F.lit(0).cast("bigint")).otherwise(_bits(_margins(v, table, planes)))


def _whole(*xs: Typed) -> bool:
    return all(x.kind == "long" for x in xs)


@function(3)
def lsh_bucket(v: Typed, table: Typed, planes: Typed) -> Typed:
    return Typed(_bucket(v.column, table.column, planes.column), "long") if v.kind == "vec" and _whole(table, planes) else null("long")


@function(3)
def lsh_bucket_int8(v: Typed, table: Typed, planes: Typed) -> Typed:
    return Typed(_bucket(v.column, table.column, planes.column), "long") if v.kind == "vec8" and _whole(table, planes) else null("long")


def _flips(order: Column, most: Column) -> Column:
    """Masks: none, each bit of `order`, each pair, each triple; `most` of them."""
    bit = lambda h: F.pow(F.lit(2.0), h.cast("double")).cast("bigint")
    one = F.transform(order, bit)
    after = lambda i: F.slice(order, i + 2, F.size(order))
    two = F.flatten(F.transform(order, lambda a, i: F.transform(after(i), lambda b: bit(a) + bit(b))))
    three = F.flatten(F.transform(order, lambda a, i: F.flatten(F.transform(after(i), lambda b, j: F.transform(F.slice(order, i + j + 3, F.size(order)), lambda c: bit(a) + bit(b) + bit(c))))))
    return F.slice(F.concat(F.array(F.lit(0).cast("bigint")), one, two, three), 1, F.greatest(most, F.lit(0)).cast("int"))


def _planes(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), F.least(F.when(n > 0, n), F.lit(MOST)) - 1)).otherwise(F.array().cast("array<bigint>"))


@function(3)
def lsh_probes(bucket: Typed, planes: Typed, n: Typed) -> Typed:
    """The bucket, then those that differ in one, two and three bits; n of them."""
    if not _whole(bucket, planes, n):
        return null("vec")
    masks = _flips(_planes(planes.column), n.column)
    return Typed(F.transform(masks, lambda m: bucket.column.bitwiseXOR(m).cast("float")), "vec")


def _ranked(v: Column, table: Column, planes: Column, n: Column) -> Column:
    margins = _margins(v, table, planes)
    near = F.transform(F.array_sort(F.transform(margins, lambda m, h: F.struct(F.abs(m).alias("d"), h.cast("bigint").alias("h")))), lambda x: x["h"])
    return F.transform(_flips(near, n), lambda m: _bits(margins).bitwiseXOR(m).cast("float"))


def _multi(kind: str):
    def build(v: Typed, table: Typed, planes: Typed, n: Typed) -> Typed:
        if v.kind != kind or not _whole(table, planes, n):
            return null("vec")
        return Typed(F.when(planes.column > 0, _ranked(v.column, table.column, planes.column, n.column)).otherwise(F.array(F.lit(0.0).cast("float"))), "vec")

    return build


function(4, name="lsh_multi_probe")(_multi("vec"))
function(4, name="lsh_multi_probe_int8")(_multi("vec8"))


@function(3)
def lsh_bucket_with_distances(v: Typed, table: Typed, planes: Typed) -> Typed:
    """Distance of v to each plane's boundary, in plane order."""
    if v.kind != "vec" or not _whole(table, planes):
        return null("vec")
    return Typed(F.transform(_margins(v.column, table.column, planes.column), lambda m: F.abs(m).cast("float")), "vec")


@function(3)
def lsh_probes_ranked(bucket: Typed, distances: Typed, n: Typed) -> Typed:
    """Probes of a bucket, flips ordered by the given boundary distances."""
    if distances.kind != "vec" or not _whole(bucket, n):
        return null("vec")
    near = F.transform(F.array_sort(F.transform(distances.column, lambda m, h: F.struct(m.alias("d"), h.cast("bigint").alias("h")))), lambda x: x["h"])
    return Typed(F.transform(_flips(near, n.column), lambda m: bucket.column.bitwiseXOR(m).cast("float")), "vec")
