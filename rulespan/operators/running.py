"""Sums and counts over all rows up to a row's own value, as running totals.

Joined by inequality they take the square of the rows. Here the values of both sides are cut
into ranges of about RANGE rows, each range is one window, and the totals of the ranges before
are added, so a task holds one range and the work grows as a sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE, RANGES = 50_000, 512


def running(left: DataFrame, shared: list[tuple[str, str]], at: str, right: DataFrame, upto: str, value: Column, op: str) -> DataFrame:
    """Columns k (at), g0.. (shared), n and s: how many rows of right have `upto op at` and equal shared columns, and their sum of value; none if n is 0."""
    turn = F.bitwise_not if op in (">", ">=") else (lambda c: c)  # an order the other way round, without overflow
    first = 0 if "=" in op else 1
    gs = [f"g{i}" for i in range(len(shared))]
    rows = right.where(F.col(upto).isNotNull()).groupBy(*[F.col(r).alias(g) for g, (_, r) in zip(gs, shared)], turn(F.col(upto)).alias("x"))
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s")).withColumn("at", F.lit(first))
    points = left.where(F.col(at).isNotNull()).select(*[F.col(c).alias(g) for g, (c, _) in zip(gs, shared)], turn(F.col(at)).alias("x")).distinct()
    points = points.withColumn("at", F.lit(1 - first))
    steps = rows.unionByName(points.withColumns({"n": F.lit(0).cast("bigint"), "s": F.lit(0).cast(rows.schema["s"].dataType), "at": F.lit(1 - first)}))
    ranges = max(1, min(RANGES, -(-steps.count() // RANGE)))
    bounds = sorted(set(steps.select(F.col("x").cast("double").alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    x = F.col("x").cast("double")
    steps = steps.withColumn("range", reduce(lambda a, b: a + b, [(x > b).cast("int") for b in bounds]) if bounds else F.lit(0))
    inside = Window.partitionBy(*gs, "range").orderBy("x", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = steps.withColumns({"n": F.sum("n").over(inside), "s": F.sum("s").over(inside)}).where(F.col("at") == 1 - first)
    if bounds:
        before = Window.partitionBy(*gs).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        totals = steps.groupBy(*gs, "range").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        totals = totals.select(*[F.col(g).alias(f"t{g}") for g in gs], F.col("range").alias("trange"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("tn"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("ts"))
        on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"t{g}")) for g in gs], F.col("range") == F.col("trange"))
        out = out.join(totals, on).withColumns({"n": F.col("n") + F.col("tn"), "s": F.col("s") + F.col("ts")})
    return out.where("n > 0").select(turn(F.col("x")).alias("k"), *gs, "n", "s")
