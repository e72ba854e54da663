"""Exact nearest neighbours, and candidate search by buckets with an exact rest.

One query vector: distances are a projection, the k best a distributed top-k. Many: all
queries meet all rows by definition, in tiles (pairs.py) that keep each query's best k before
anything is shuffled. Where vectors do not fit tiles, a join with the queries in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RuleError
from ..functions.vectors import cosine_distance, dot, euclidean, manhattan
from . import pairs

#: Query vectors that one broadcast block may hold (64 dimensions: about 5 MB).
BLOCK = 20_000


def distance(metric: str, a: Column, b: Column) -> Column:
    """Smaller is nearer; dot_product is minus the cosine, as vectors are normalised for it."""
    if metric == "cosine":
        return cosine_distance(a, b, 0.0)
    if metric == "euclidean":
        return euclidean(a, b)
    if metric == "manhattan":
        return manhattan(a, b)
    if metric == "dot_product":
        return cosine_distance(a, b, 1.0) - 1
    if metric == "dot":
        return -dot(a, b)
    raise RuleError(f"no metric {metric}")


def nearest(df: DataFrame, id_col: str, vec_col: str, query: list[float], k: int | None = None, radius: float | None = None, metric: str = "cosine") -> DataFrame:
    """(id, distance) of the k nearest, of those within radius, or both."""
    q = F.array(*[F.lit(float(x)) for x in query]).cast("array<float>")
    out = df.select(F.col(id_col), distance(metric, F.col(vec_col), q).alias("distance"))
    if radius is not None:
        out = out.where(F.col("distance") <= radius)
    return out.orderBy("distance", id_col).limit(k) if k is not None else out


def tiled(queries: DataFrame, key_cols: list[str], query_col: str, rows: DataFrame, id_col: str, vec_col: str, k: int, metric: str, others_only: bool = False) -> DataFrame | None:
    """Columns l0.. (keys), r0 (id), d0 (distance), rank: the k nearest of every query; None where keys repeat, ids do not or vectors do not fit tiles."""
    name = {"cosine": "cosine", "euclidean": "euclidean", "manhattan": "manhattan"}.get(metric)
    whole = ("bigint", "int", "smallint", "tinyint")
    if name is None or k < 1 or rows.schema[id_col].dataType.simpleString() not in whole or (others_only and queries.schema[key_cols[0]].dataType.simpleString() not in whole):
        return None
    left = pairs.described(pairs.Side(queries, (), tuple(key_cols), query_col), key_cols)
    right = pairs.described(pairs.Side(rows, (), (id_col,), vec_col), [id_col])
    if left is None or right is None or left.size != right.size or not (left.unique and right.unique) or min(left.rows, right.rows) <= pairs.FEW:
        return None
    if not rows.where(F.col(id_col).isNull()).isEmpty() or others_only and not queries.where(F.col(key_cols[0]).isNull()).isEmpty():
        return None
    found = pairs.distances(left, right, [name], k, (key_cols[0], id_col) if others_only else None, id_col)
    best = Window.partitionBy(*[f"l{i}" for i in range(len(key_cols))]).orderBy("d0", "r0")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest_each(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str, k: int, metric: str = "cosine", others_only: bool = True) -> DataFrame:
    """(query, id, distance, rank): the k nearest rows of every query row, ties to the smaller id."""
    found = tiled(queries, [id_col], vec_col, rows, id_col, vec_col, k, metric, others_only)
    if found is not None:
        return found.select(F.col("l0").alias("query"), F.col("r0").alias("id"), F.col("d0").alias("distance"), "rank")
    q = queries.select(F.col(id_col).alias("query"), F.col(vec_col).alias("qv"))
    n = q.count()
    blocks = max(1, -(-n // BLOCK))
    r = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("rv"))
    parts = []
    for i in range(blocks):
        mine = q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i) if blocks > 1 else q
        pairs = r.join(F.broadcast(mine), F.col("query") != F.col("id") if others_only else F.lit(True))
        parts.append(pairs.select("query", "id", distance(metric, F.col("qv"), F.col("rv")).alias("distance")))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    best = Window.partitionBy("query").orderBy("distance", "id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
