"""Eight-bit vectors and distances over them. Unlike over floats, the cosine distance to a vector without length is 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import takes
from .vectors import cosine_distance, dot, euclidean, manhattan, once


def _bytes(values: Column) -> Column:
    return F.transform(values, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), x)).cast("tinyint"))


def _round(x: Column) -> Column:
    """Half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


@takes("vec", "vec8", "quantize_linear")
def quantize_linear(v: Column) -> Column:
    """[min, max] to [-128, 127]; a constant vector to zeros."""
    def scaled(bounds: Column) -> Column:
        low, high = bounds["low"], bounds["high"]
        values = lambda scale: F.when(scale.isNull(), F.transform(v, lambda x: F.lit(0).cast("tinyint"))).otherwise(_bytes(F.transform(v, lambda x: _round((x.cast("double") - low) * scale - 128.0))))
        return once(F.when(high > low, 255.0 / F.when(high > low, high - low)), values)

    return once(F.struct(F.array_min(v).cast("double").alias("low"), F.array_max(v).cast("double").alias("high")), scaled)


@takes("vec", "vec8", "quantize_symmetric")
def quantize_symmetric(v: Column) -> Column:
    """[-m, m] to [-127, 127], m the largest magnitude; zeros stay."""
    def scaled(most: Column) -> Column:
        values = lambda scale: F.when(scale.isNull(), F.transform(v, lambda x: F.lit(0).cast("tinyint"))).otherwise(_bytes(F.transform(v, lambda x: _round(x.cast("double") * scale))))
        return once(F.when(most > 0, 127.0 / F.when(most > 0, most)), values)

    return once(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), scaled)


takes("vec8", "vec", "dequantize")(lambda q: q.cast("array<float>"))
takes("vec8 num", "vec", "dequantize_scaled")(lambda q, s: F.transform(q, lambda x: (x.cast("float") * s.cast("float")).cast("float")))
takes("vec8 vec8", "double", "euclidean_int8")(euclidean)
takes("vec8 vec8", "double", "cosine_int8")(lambda a, b: cosine_distance(a, b, 1.0))
takes("vec8 vec8", "double", "dot_int8")(dot)
takes("vec8 vec8", "double", "manhattan_int8")(manhattan)
takes("vec8 vec8 num", "double", "euclidean_dequantized")(lambda a, b, s: euclidean(a, b) * s)
takes("vec8 vec8", "double", "cosine_dequantized")(lambda a, b: cosine_distance(a, b, 0.0))
