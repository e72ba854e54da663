"""Number conversions; strings are not parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import Typed, function, null


@function(1)
def to_float(x: Typed) -> Typed:
    return Typed(x.column.cast("double"), "double") if x.numeric else null("double")


@function(1)
def to_int(x: Typed) -> Typed:
    """Towards zero; what is not finite is null, what is too large is the nearest long."""
    if x.kind == "long":
        return x
    if x.kind != "double":
        return null("long")
    finite = ~F.isnan(x.column) & (F.abs(x.column) != float("inf"))
    clamped = F.when(x.column >= 9.223372036854775e18, F.lit((1 << 63) - 1)).when(x.column <= -9.223372036854775e18, F.lit(-(1 << 63))).otherwise(F.when(F.abs(x.column) < 9.223372036854775e18, x.column).cast("bigint"))
    return Typed(F.when(finite, clamped), "long")
