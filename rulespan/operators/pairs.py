"""Distances between the vectors of two tables, worked out in tiles.

A join of two tables with vectors would carry two arrays a pair and fold them element by
element. Here each side is packed into blocks of up to BLOCK rows of one join key, every two
blocks with equal keys are a tile, and numpy works out a tile in one task: what a task holds
is bounded by two blocks and CHUNK pairs, and no task depends on how many rows a key has.
Sums run over the dimensions in order, as in functions/vectors.py, so the doubles are the
same; sums of eight-bit vectors are exact in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a block, pairs at a time, most partitions of tiles, and rows of the smaller side below which a plain join is as good.
BLOCK, CHUNK, PARTS, FEW = 4096, 1 << 17, 6000, 16
#: function of the rule language -> (kind of vector, measure, cosine distance to a vector without length)
KERNELS = {
    "euclidean": ("vec", "euclidean", 0.0), "cosine": ("vec", "cosine", 0.0), "dot": ("vec", "dot", 0.0), "manhattan": ("vec", "manhattan", 0.0),
    "euclidean_int8": ("vec8", "euclidean", 0.0), "cosine_int8": ("vec8", "cosine", 1.0), "dot_int8": ("vec8", "dot", 0.0), "manhattan_int8": ("vec8", "manhattan", 0.0),
}


@dataclass(frozen=True)
class Side:
    """One table: its join keys, the columns that are shown with a pair, and its vectors."""

    df: DataFrame
    keys: tuple[str, ...]
    carried: tuple[str, ...]
    vector: str
    rows: int = 0
    most: int = 0  # rows of the most frequent key
    size: int = 0  # of each vector
    unique: bool = False  # the columns in `by` tell rows apart
    groups: int = 0


def described(side: Side, by: list[str]) -> Side | None:
    """The side with its counts, or None where vectors are null, of several lengths, or hold nulls, NaN or infinities."""
    v = F.col(side.vector)
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    size = F.size(v)
    counts = side.df.groupBy(*side.keys).agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("a"), F.max(size).alias("b"), F.max(F.coalesce(bad, F.lit(True))).alias("bad"))
    n, most, a, b, bad, groups = counts.agg(F.sum("n"), F.max("n"), F.min("a"), F.max("b"), F.max("bad"), F.count(F.lit(1))).first()
    if not n or bad or a != b or a < 1:
        return None
    unique = n == 1 if not by else side.df.groupBy(*by).count().where("count > 1").isEmpty()
    return Side(side.df, side.keys, side.carried, side.vector, n, most, a, unique, groups)


def _matrix(lists: pa.Array, size: int, dtype) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(dtype)


def _squares(m: np.ndarray) -> np.ndarray:
    out = np.zeros(len(m))
    for d in range(m.shape[1]):
        out += m[:, d] * m[:, d]
    return out


def _sums(a: np.ndarray, bt: np.ndarray, want: set[str], exact: bool) -> dict[str, np.ndarray]:
    """Dots, squared and absolute differences of all rows of a with all columns of bt."""
    shape = (len(a), bt.shape[1])
    out: dict[str, np.ndarray] = {}
    if exact:  # whole numbers: a product of matrices has no rounding while sums stay under the mantissa
        kind = np.float32 if len(bt) < 1000 else np.float64
        if want & {"dot", "squares"}:
            out["dot"] = (a.astype(kind) @ bt.astype(kind)).astype(np.float64)
        if "squares" in want:
            out["squares"] = _squares(a)[:, None] + _squares(bt.T)[None, :] - 2 * out["dot"]
        if "absolute" in want:
            kind = np.int16 if len(bt) <= 128 else np.int32
            x, y, t, found = a.astype(kind), np.ascontiguousarray(bt.astype(kind)), np.empty(shape, kind), np.zeros(shape, kind)
            for d in range(len(bt)):
                np.subtract(x[:, d, None], y[d], out=t)
                np.abs(t, out=t)
                found += t
            out["absolute"] = found.astype(np.float64)
        return out
    out = {w: np.zeros(shape) for w in want}
    t, u = np.empty(shape), np.empty(shape)
    for d in range(len(bt)):
        x, y = a[:, d, None], bt[d]
        if "dot" in want:
            np.multiply(x, y, out=t)
            out["dot"] += t
        if want & {"squares", "absolute"}:
            np.subtract(x, y, out=t)
        if "squares" in want:
            np.multiply(t, t, out=u)
            out["squares"] += u
        if "absolute" in want:
            np.abs(t, out=t)
            out["absolute"] += t
    return out


NEEDS = {"euclidean": "squares", "manhattan": "absolute", "dot": "dot", "cosine": "dot"}


def _measure(name: str, of_zero: float, sums: dict[str, np.ndarray], norms: np.ndarray) -> np.ndarray:
    if name == "euclidean":
        return np.sqrt(sums["squares"])
    if name == "cosine":
        some = norms > 0
        cos = np.clip(sums["dot"] / np.where(some, norms, 1.0), -1.0, 1.0)
        return np.where(some, 1 - cos, of_zero)
    return sums[NEEDS[name]]


def _nearest(a: np.ndarray, b: np.ndarray, bt: np.ndarray, na: np.ndarray, nb: np.ndarray, k: int, name: str, of_zero: float, apart: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, measure): for each row of a the k least by (measure, row of b); a matrix product picks who is worked out in order."""
    if name == "manhattan":
        rough, slack = _sums(a, bt, {"absolute"}, False)["absolute"], 0.0
    else:
        rough = a @ bt
        if name == "euclidean":
            rough *= -2
            rough += (na * na)[:, None]
            rough += (nb * nb)[None, :]
            slack = 1e-11 * float((na * na).max() + (nb * nb).max())
        elif name == "cosine":
            norms = na[:, None] * nb[None, :]
            rough = np.where(norms > 0, 1 - rough / np.where(norms > 0, norms, 1.0), of_zero)
            slack = 1e-11
        else:
            slack = 1e-11 * float(na.max() * nb.max())
    if apart is not None:
        rough[apart] = np.inf
    k = min(k, rough.shape[1])
    mine = rough <= np.partition(rough, k - 1, axis=1)[:, k - 1, None] + slack
    if apart is not None:
        mine &= ~apart
    i, j = np.nonzero(mine)
    need = NEEDS[name]
    sums = np.zeros(len(i))
    for d in range(len(bt)):
        x, y = a[i, d], b[j, d]
        if need == "dot":
            sums += x * y
        elif need == "squares":
            t = x - y
            sums += t * t
        else:
            sums += np.abs(x - y)
    far = _measure(name, of_zero, {need: sums}, na[i] * nb[j])
    order = np.lexsort((j, far, i))
    i, j, far = i[order], j[order], far[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
    return i[rank < k], j[rank < k], far[rank < k]


def distances(left: Side, right: Side, functions: list[str], k: int | None = None, apart: tuple[str, str] | None = None, tie: str | None = None) -> DataFrame:
    """Columns k0.. (keys), l0.., r0.. (carried), d0.. (functions) of every pair with equal keys.

    With k only a tile's k nearest of each left row by the one function, smaller `tie` (a column
    of longs carried by the right side) first: a ranking over all of them gives the k nearest.
    apart: columns of longs that must differ.
    """
    spark = left.df.sparkSession
    keys, size = len(left.keys), left.size
    kernels = [KERNELS[f] for f in functions]
    exact = kernels[0][0] == "vec8"
    want = {NEEDS[m] for _, m, _ in kernels}
    cores = spark.sparkContext.defaultParallelism
    rows = max(256, min(BLOCK, -(-right.most // (2 * cores))))
    nl, nr = max(1, -(-left.most // BLOCK)), max(1, -(-right.most // rows))

    def packed(side: Side, mine: int, others: int, name: str, own: str, other: str) -> DataFrame:
        parts = [F.col(c).alias(f"c{i}") for i, c in enumerate(side.carried)] + [F.col(side.vector).alias("v")]
        at = F.pmod(F.xxhash64(*(side.carried or (side.vector,))), F.lit(mine)).cast("int").alias(own)
        blocks = side.df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(side.keys)], at, F.struct(*parts).alias("row"))
        blocks = blocks.groupBy(*[f"k{i}" for i in range(keys)], own).agg(F.collect_list("row").alias(name))
        return blocks.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    tiles = packed(left, nl, nr, "left", "a", "b").unionByName(packed(right, nr, nl, "right", "b", "a"), allowMissingColumns=True)
    tiles = tiles.repartition(min(PARTS, max(1, nl * nr * left.groups)), *[f"k{i}" for i in range(keys)], "a", "b")
    shown = [T.StructField(f"k{i}", left.df.schema[c].dataType) for i, c in enumerate(left.keys)]
    shown += [T.StructField(f"l{i}", left.df.schema[c].dataType) for i, c in enumerate(left.carried)]
    shown += [T.StructField(f"r{i}", right.df.schema[c].dataType) for i, c in enumerate(right.carried)]
    shown += [T.StructField(f"d{i}", T.DoubleType()) for i in range(len(functions))]
    n_left, n_right = len(left.carried), len(right.carried)
    at_tie = right.carried.index(tie) if tie else None
    at_apart = (left.carried.index(apart[0]), right.carried.index(apart[1])) if apart else None
    chunk = CHUNK

    def batch(values: list, x: pa.StructArray, y: pa.StructArray, i: np.ndarray, j: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
        i, j = pa.array(i), pa.array(j)
        out = [pa.array([v.as_py()], v.type).take(pa.array(np.zeros(len(i), np.int64))) for v in values]
        out += [x.field(c).take(i) for c in range(n_left)] + [y.field(c).take(j) for c in range(n_right)]
        out += [pa.array(d) for d in found]
        return pa.record_batch(out, names=[f.name for f in shown])

    def tile(values: list, x: pa.StructArray, y: pa.StructArray) -> Iterator[pa.RecordBatch]:
        if at_tie is not None:
            y = y.take(pa.array(np.argsort(y.field(at_tie).to_numpy(zero_copy_only=False), kind="stable")))
        a, b = _matrix(x.field(n_left), size, np.float64), _matrix(y.field(n_right), size, np.float64)
        bt = np.ascontiguousarray(b.T)
        na, nb = np.sqrt(_squares(a)), np.sqrt(_squares(b))
        step = max(1, (8 * chunk if k else chunk) // len(b))
        for s in range(0, len(a), step):
            part, norms = a[s : s + step], na[s : s + step]
            if k:
                same = None
                if at_apart:
                    same = x.field(at_apart[0]).to_numpy(zero_copy_only=False)[s : s + step, None] == y.field(at_apart[1]).to_numpy(zero_copy_only=False)[None, :]
                i, j, far = _nearest(part, b, bt, norms, nb, k, kernels[0][1], kernels[0][2], same)
                yield batch(values, x, y, i + s, j, [far])
                continue
            sums, scale = _sums(part, bt, want, exact), norms[:, None] * nb[None, :]
            found = [_measure(m, zero, sums, scale).ravel() for _, m, zero in kernels]
            i = np.repeat(np.arange(s, s + len(part)), len(b))
            yield batch(values, x, y, i, np.tile(np.arange(len(b)), len(part)), found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, tuple[pa.StructArray | None, pa.StructArray | None]] = {}
        for got in batches:
            for n in range(got.num_rows):
                values = [got.column(f"k{i}")[n] for i in range(keys)]
                at = (*[v.as_py() for v in values], got.column("a")[n].as_py(), got.column("b")[n].as_py())
                x, y = got.column("left")[n].values, got.column("right")[n].values
                before = waiting.pop(at, (None, None))
                x, y = x if x is not None else before[0], y if y is not None else before[1]
                if x is None or y is None:
                    waiting[at] = (x, y)
                    continue
                yield from tile(values, x, y)

    return tiles.mapInArrow(run, T.StructType(shown))
