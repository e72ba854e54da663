"""Aggregates over distinct bindings. A group-less aggregate over no rows gives no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RuleError
from ..functions.mathematics import number
from ..functions.registry import Typed


def simple(name: str, x: Typed, non_null: bool) -> Typed:
    """Null is a value: it counts, is 0 in sums and means, distinct from others, and the least."""
    c = x.column
    if name == "count":
        return Typed(F.count(F.lit(1)), "long")
    if name == "count_distinct":
        found = F.count_distinct(c)
        return Typed(found if non_null else found + F.max(c.isNull().cast("bigint")), "long")
    if name == "sum":
        if x.kind == "long":
            return Typed(F.sum(c if non_null else F.coalesce(c, F.lit(0))), "long")
        return Typed(F.sum(number(x)), "double") if x.kind == "double" else Typed(F.sum(F.lit(0)), "long")
    if name == "avg":
        return Typed(F.avg(number(x)), "double")
    if name == "max":
        return Typed(F.max(c), x.kind)
    if name == "min":
        return Typed(F.min(c) if non_null else F.when(F.count(c) == F.count(F.lit(1)), F.min(c)), x.kind)
    raise RuleError(f"no aggregate {name}")


def grouped(df: DataFrame, keys: list[str], aggregates: list[tuple[str, Column]]) -> DataFrame:
    named = [c.alias(n) for n, c in aggregates]
    if keys:
        return df.groupBy(*keys).agg(*named)
    return df.agg(*named, F.count(F.lit(1)).alias("__rows")).where("__rows > 0").drop("__rows")


def ranked(df: DataFrame, name: str, keys: list[str], shown: list[str], params: tuple[float, ...], order: str, descending: bool) -> DataFrame:
    """Rows that top_k, top_k_threshold or within_radius keep; ties in order fall to the smaller shown values."""
    df = df.select(*dict.fromkeys(keys + shown + [order])).distinct()
    at = F.col(order)
    if name == "within_radius":
        return df.where(at <= params[0])
    if name == "top_k_threshold":
        df = df.where(at >= params[1] if descending else at <= params[1])
    first = [at.desc_nulls_last() if descending else at.asc_nulls_first()] + [F.col(c).asc_nulls_first() for c in shown if c != order]
    k = int(params[0])
    if not keys:
        return df.orderBy(*first).limit(k)  # a top-k of each partition, then of those
    # Spark cuts each partition's groups to k before the shuffle (WindowGroupLimit).
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*first))).where(F.col("__rank") <= k).drop("__rank")
