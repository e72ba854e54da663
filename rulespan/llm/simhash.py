"""SimHash near-duplicates through pivot distance tables.

A fingerprint is 64 bits, each the majority over the XXH64 hashes of a text's three-word
shingles. Equal fingerprints collapse first. Every distinct one gets a row of the pivot
table: its Hamming distances to fixed reference fingerprints, packed a byte each. Distance
to a pivot is 1-Lipschitz, so a pair whose rows differ by more than the limit in any
coordinate cannot link; the others are verified on all 64 bits.

Which pairs are looked at: five bit blocks, of which a pair within three bits shares at least
two, so ten keys (two blocks each) lose no link. A key's rows are compared in one task in
vectorised steps of equal lag, memory linear in its rows; keys above TILE rows are dealt into
pairs of chunks, each pair a task of its own. Each key gives the edges of a spanning forest,
never all pairs; distributed components over them give the groups.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other. A
component's id is its smallest non-null doc_id (null if it has none); rows with a null
doc_id, repeated rows and repeated ids all get their fingerprint's component. Other columns
are ignored, or kept by keep_one(). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .components import SMALL, components

LIMIT = 3  # differing bits
SHINGLE = 3  # words
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (first bit, bits)
PIVOTS = 8  # bytes of the packed table row
TILE = 2048  # rows of a key that one task compares


def pivots() -> list[int]:
    """Reference fingerprints: hashes of their own numbers, so the same everywhere."""
    return [xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(PIVOTS)]


def hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `size` words of the whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends[:-size + 1] - np.diff(ends, prepend=0)[:-size + 1]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), (ends[size - 1 :] - 1).tolist())
    return np.fromiter((digest(flat[a:b], 42) for a, b in spans), np.uint64, len(words) - size + 1)


def fold(parts: list[np.ndarray], step: int = 1 << 16) -> np.ndarray:
    """A fingerprint for each array of hashes; a bit is set if it is in over half of them."""
    sizes = np.array([len(p) for p in parts], np.int64)
    ones = np.zeros((len(parts), 64), np.int64)
    every = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(parts)), sizes)
    for at in range(0, len(every), step):
        bits = np.unpackbits(every[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[at : at + step]
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        ones[mine[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, fp: bigint, the unsigned fingerprint's bits) for every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                fp = fold([hashes(t) for t in b.column(len(keys)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], [*keys, "fp"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*keys, F.col(text_col).cast("string")).mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", fp bigint")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def _near(fp: np.ndarray, table: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (places) of the links within groups of equal, adjacent `group` values."""
    n = len(fp)
    label = np.arange(n)
    left = np.arange(n)
    for lag in range(1, n):
        left = left[left + lag < n]
        left = left[group[left] == group[left + lag]]
        if not len(left):
            break
        a, b = left, left + lag
        apart = np.abs(table[a].astype(np.int16) - table[b]).max(axis=1) <= LIMIT  # pivot coordinates
        a, b = a[apart], b[apart]
        close = popcount(fp[a] ^ fp[b]) <= LIMIT  # survivors
        a, b = a[close], b[close]
        while len(a):  # union: hook the larger root to the smaller, then shorten paths
            ra, rb = label[a], label[b]
            while (label[ra] != ra).any() or (label[rb] != rb).any():
                ra, rb = label[ra], label[rb]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
    while (label[label] != label).any():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (key, tile) in tables that end with a group."""
    held: pa.Table | None = None
    for batch in batches:
        held = pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks() if held is not None else pa.Table.from_batches([batch])
        if not held.num_rows:
            continue
        key, tile = held["key"].to_numpy(), held["tile"].to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))
        if len(cut):  # the last group may go on in the next batch
            at = int(cut[-1]) + 1
            yield held.slice(0, at).combine_chunks()
            held = held.slice(at)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, tile, fp, pivots), sorted by (key, tile), to edges (a, b) of fingerprints."""

    def edges(t: pa.Table) -> pa.RecordBatch:
        fp = t["fp"].to_numpy().view(np.uint64)
        table = t["pivots"].to_numpy().view(np.uint8).reshape(-1, PIVOTS)
        key, tile = t["key"].to_numpy(), t["tile"].to_numpy()
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]))
        a, b = _near(fp, table, group)
        return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])

    yield from map(edges, whole_groups(batches))


def _block(i: int):
    first, bits = BLOCKS[i]
    return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def links(distinct: DataFrame, ws: Workspace, tile: int = TILE) -> DataFrame:
    """distinct(fp) -> edges (a, b) whose components are those of all pairs within LIMIT bits."""
    packed = F.lit(0).cast("bigint")
    for i, p in enumerate(pivots()):
        far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(p - (1 << 64) if p >> 63 else p).cast("bigint"))).cast("bigint")
        packed = packed.bitwiseOR(F.shiftleft(far, 8 * i))
    table = ws.write(distinct.select("fp", packed.alias("pivots")), "pivots")
    pairs = [(i, j) for i in range(len(BLOCKS)) for j in range(i)]
    keys = F.array(*[F.shiftleft(F.lit(t).cast("bigint"), 32).bitwiseOR(F.shiftleft(_block(i), 13)).bitwiseOR(_block(j)) for t, (i, j) in enumerate(pairs)])
    rows = table.select("fp", "pivots", F.explode(keys).alias("key"))
    hot = ws.write(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("key", F.ceil(F.col("n") / (tile // 2)).cast("int").alias("chunks")), "hot")
    if hot.isEmpty():
        tiled = rows.withColumn("tile", F.lit(0))
    else:
        # Chunk c of m meets every chunk once: it goes to tiles (c, d) and (d, c), named low * m + high.
        split = rows.join(hot, "key", "left").withColumn("c", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int"))
        others = F.expr("transform(sequence(0, coalesce(chunks, 1) - 1), d -> least(c, d) * coalesce(chunks, 1) + greatest(c, d))")
        tiled = split.select("fp", "pivots", "key", F.explode(others).alias("tile"))
    dealt = tiled.select("key", "tile", "fp", "pivots").repartition("key", "tile").sortWithinPartitions("key", "tile")
    return dealt.mapInArrow(_links, "a bigint, b bigint")


def _classes(marked: DataFrame, ws: Workspace, near: DataFrame | None = None, small: int = 0) -> DataFrame:
    """marked(doc_id, fp) -> (fp, root, component_id) for every distinct fingerprint; near: edges if not links()."""
    distinct = ws.write(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    near = ws.write(links(distinct.select("fp"), ws) if near is None else near, "links")
    roots = components(near, ws, small=small)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    # Only groups of several fingerprints can change their id.
    low = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return ws.write(rooted.join(low, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, ws: Workspace) -> DataFrame:
    """One row a document: doc_id, fingerprint, component_id (query op2_simhash_near_dedup)."""
    marked = ws.write(fingerprints(docs.select("doc_id", "text"), ["doc_id"]), "marked")
    classes = _classes(marked, ws)
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, ws: Workspace) -> DataFrame:
    """docs, same columns: of each component one row of the smallest doc_id stays.

    Rows of a null doc_id stay only where their component has no other; ties go to the row
    with the smallest content hash. Fingerprint, hash and id of each row are written first,
    the choice is made on those alone, and texts are joined to the chosen ids once.
    """
    slim = ws.write(fingerprints(docs.select("doc_id", content(docs).alias("row"), "text"), ["doc_id", "row"]), "marked")
    return one_of_each(docs, slim, None, ws)


def content(docs: DataFrame) -> Column:
    """A hash of the whole row."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(docs: DataFrame, slim: DataFrame, near: DataFrame | None, ws: Workspace) -> DataFrame:
    """keep_one() for slim(doc_id, row: content(), fp) and edges `near` between fps."""
    classes = _classes(slim, ws, near, SMALL)
    # The least id of each component, by an aggregate that combines map-side.
    first = slim.join(classes, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("b"))
    chosen = ws.write(first.select(F.col("b.id").alias("__rs_id"), F.col("b.row").alias("__rs_row")), "chosen")
    same = docs["doc_id"].eqNullSafe(F.col("__rs_id")) & (F.col("__rs_hash") == F.col("__rs_row"))
    kept = docs.withColumn("__rs_hash", content(docs)).join(chosen, same, "left_semi")
    # Wholly equal rows share id and hash; of those one stays.
    twins = slim.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__rs_id"), F.col("row").alias("__rs_row"))
    twins = ws.write(twins, "twins")
    if not twins.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("__rs_id")) & (F.col("__rs_hash") == F.col("__rs_row"))
        kept = kept.join(twins, same, "left_anti").union(kept.join(twins, same, "left_semi").dropDuplicates(["doc_id", "__rs_hash"]))
    return kept.drop("__rs_hash")
