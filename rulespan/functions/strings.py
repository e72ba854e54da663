"""String functions. Lengths and offsets count UTF-8 bytes only where the text is ASCII; substr counts characters. No string gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Typed, function, takes

takes("string", "long", "len")(lambda s: F.octet_length(s).cast("bigint"))
takes("string", "string", "upper")(F.upper)
takes("string", "string", "lower")(F.lower)
takes("string", "string", "trim")(lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
takes("string string string", "string", "replace")(lambda s, a, b: F.replace(s, a, b))


@takes("string ts ts", "string", "substr")
def substr(s: Column, start: Column, length: Column) -> Column:
    """From 0; a negative start or length gives the empty string."""
    return F.when((start < 0) | (length < 0), F.lit("")).otherwise(F.substring(s, start.cast("int") + 1, length.cast("int")))


def shown(x: Typed) -> Column:
    """As text: whole doubles without a fraction, null as `null`."""
    if x.kind == "double":
        whole = (x.column == F.floor(x.column)) & (F.abs(x.column) < 1e15)
        return F.coalesce(F.when(whole, x.column.cast("bigint").cast("string")).otherwise(x.column.cast("string")), F.lit("null"))
    return F.coalesce(x.column.cast("string"), F.lit("null"))


@function(2, None)
def concat(*xs: Typed) -> Typed:
    return Typed(F.concat(*[shown(x) for x in xs]), "string")
