"""Connected components of a distributed edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

SMALL = 100_000  # edges that the driver may take, where a caller allows it


def _on_driver(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to (nodes, roots)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, (x, y) = np.arange(len(nodes)), ends.reshape(2, -1)
    while len(x):  # hook the larger root to the smaller, then shorten paths
        x, y = label[x], label[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def components(edges: DataFrame, ws: Workspace, rounds: int = 60, small: int = 0) -> DataFrame:
    """edges(a, b: bigint) -> (node, root), root the smallest node reachable; isolated nodes are absent.

    Large-star then small-star steps (Kiveris et al. 2014) until the edge set is a forest
    of stars. Each half step aggregates a node's minimum with map-side combining, then joins
    it back; AQE splits the join's partition of a hub. Every round is written to the shared
    folder, so lineage stays short. Null ends and loops are ignored; no edges give no rows.
    Raises if `rounds` rounds do not settle it (that takes a path of about 2**rounds nodes).
    At most `small` edges (checked with a limit) are settled on the driver instead of by some ten jobs.
    """
    now = ws.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc0")
    last = None
    if small and (few := now.limit(small + 1).toArrow()).num_rows <= small:
        nodes, roots = _on_driver(few["a"].to_numpy(), few["b"].to_numpy())
        return ws.write(ws.spark.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(roots, pa.int64())})), "roots")
    for i in range(1, rounds + 1):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        ws.write(small, f"cc{i}")
        now = ws.read(f"cc{i}")
        ws.drop(f"cc{i - 1}")
        n, targets, mark = now.agg(F.count("*"), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == targets and (n, mark) == last or not n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = (n, mark)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
