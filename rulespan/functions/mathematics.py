"""Arithmetic and mathematical functions. What is no number counts as 0.0, except in abs_int64, min_val and max_val."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import RuleError
from .registry import Typed, function, null

LOW = -(1 << 63)


def number(x: Typed):
    """As a double; what is no number is 0.0."""
    return F.coalesce(x.column.cast("double"), F.lit(0.0)) if x.numeric else F.lit(0.0)


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    """+ - * % keep two longs long; / is a double; division and remainder by zero are null; overflow is null."""
    whole = a.kind == b.kind == "long" and op != "/"
    x, y = (a.column, b.column) if whole else (number(a), number(b))
    if op == "/":
        return Typed(F.when(y != 0, x / y), "double")
    if op == "%":
        return Typed(F.when(y != 0, F.try_mod(x, y)), "long" if whole else "double")
    found = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}.get(op)
    if found is None:
        raise RuleError(f"no operator {op}")
    return Typed(found(x, y), "long" if whole else "double")


@function(1)
def abs_int64(x: Typed) -> Typed:
    return Typed(F.when(x.column == LOW, F.lit(-(LOW + 1))).otherwise(F.abs(F.when(x.column != LOW, x.column))), "long") if x.kind == "long" else null("long")


@function(1)
def abs_float64(x: Typed) -> Typed:
    return Typed(F.abs(number(x)), "double")


@function(1, name="abs")
def abs_(x: Typed) -> Typed:
    return abs_int64(x) if x.kind == "long" else abs_float64(x)


@function(1)
def sqrt(x: Typed) -> Typed:
    return Typed(F.when(number(x) >= 0, F.sqrt(number(x))), "double")


@function(2, name="pow")
def pow_(b: Typed, e: Typed) -> Typed:
    return Typed(F.pow(number(b), number(e)), "double")


@function(1)
def log(x: Typed) -> Typed:
    return Typed(F.when(number(x) > 0, F.ln(number(x))), "double")


def _double(name: str, f) -> None:
    function(1, name=name)(lambda x: Typed(f(number(x)), "double"))


for _name, _f in (("exp", F.exp), ("sin", F.sin), ("cos", F.cos), ("tan", F.tan)):
    _double(_name, _f)


@function(1)
def floor(x: Typed) -> Typed:
    return Typed(F.floor(number(x)).cast("bigint"), "long")


@function(1)
def ceil(x: Typed) -> Typed:
    return Typed(F.ceil(number(x)).cast("bigint"), "long")


@function(1)
def sign(x: Typed) -> Typed:
    """-1, 0 or 1; NaN is -1."""
    v = number(x)
    return Typed(F.when(F.isnan(v) | (v < 0), F.lit(-1)).when(v > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"), "long")


def _extreme(name: str, pick) -> None:
    def build(a: Typed, b: Typed) -> Typed:
        if a.kind == b.kind == "string" or a.kind == b.kind == "long":
            kind, x, y = a.kind, a.column, b.column
        elif a.numeric and b.numeric:
            kind, x, y = "double", number(a), number(b)
        else:
            return null("string" if "string" in (a.kind, b.kind) else "double")
        return Typed(F.when(a.column.isNotNull() & b.column.isNotNull(), pick(x, y)), kind)

    function(2, name=name)(build)


_extreme("min_val", F.least)
_extreme("max_val", F.greatest)
