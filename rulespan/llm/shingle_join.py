"""Near copies by word shingles: all pairs of Jaccard similarity 0.8 or more over five words.

A text is the set of its five-word shingles' XXH64 hashes (lower-cased, white space split; a
shorter text is one shingle). A pair at or above the limit shares at least ceil(0.8 n) of
either side's n shingles, so under any common order of shingles it shares one of the first
n - ceil(0.8 n) + 1: no pair is lost. The order puts shingles that a sample finds in many
texts last, then goes by hash; the sample decides the cost, never the result.

Rows of shingles that one text alone holds in its first ones are dropped at once, and of
shingles that the same texts hold one stays. Each text that is left has a sketch: which of its
shingles' low bits occur an odd number of times, in a bit a shingle or more. Two sketches differ
in no more bits than the sets differ in shingles, so sizes and sketches rule pairs out without a
loss; the halves of a longer sketch fold into one of half its length. What is left is compared
on whole texts:

* first the links of simhash.py: every text's fingerprint goes through its pivot distance table,
  and texts of one fingerprint or of linked ones are compared. Most copies come together here;
* in rounds, what three bits of a fingerprint leave apart: each text with one of its shingles'
  pivots (a few texts of a shingle, others each round). So a large group makes few pairs;
* at last, what is still apart, in tiles of bounded size. First all pairs of a shingle, by
  sketches: a tile gives a spanning forest of the pairs that these allow, whose components are
  classes that hold every such pair. Then all pairs of a class, on whole sets: a tile gives a
  spanning forest of the pairs at the limit. So no step makes more rows than it reads. A
  shingle whose texts are all of one component has none.

On disk lie the candidates' texts, once, and no shingle sets, which take more than the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Workspace
from .components import SMALL, components

WORDS = 5
PART, WHOLE = 4, 5  # similarity 4/5
SAMPLE = 8  # one document in so many is looked at for common shingles
BITS = 512  # of a sketch at least
PIVOTS, ROUNDS = 8, 3
TILE = 2048  # rows of a shingle or a class that one task compares
WEIGHT = 1 << 21  # shingles of a class that one task compares
STEP = 1 << 22  # bytes of sketches compared at once
COMMON, MOST = 3, 1_000_000  # documents of the sample that make a shingle common; shingles kept


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(simhash.hashes(text, WORDS))


def first(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which a similar text must share one; `common` is sorted."""
    keep = len(s) - (PART * len(s) + WHOLE - 1) // WHOLE + 1 if len(s) else 0
    if not len(common):
        return s[:keep]
    late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.concatenate([s[~late], s[late]])[:keep]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def sets(docs: DataFrame, key: str) -> DataFrame:
    """docs(key, text) -> (key, s: array<bigint>, bits: binary, the sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                each = [shingles(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(each), pa.array([sketch(s) for s in each], pa.binary())], [key, "s", "bits"])

    return docs.select(key, F.col("text").cast("string")).mapInArrow(run, f"`{key}` bigint, s array<bigint>, bits binary")


def sketch(s: np.ndarray) -> bytes:
    """Which values of the shingles' low bits occur an odd number of times; a power of two of bits, one a shingle or more."""
    bits = max(BITS, 1 << max(len(s) - 1, 0).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def common_shingles(docs: DataFrame, ws: Workspace) -> np.ndarray:
    """docs(row: a hash, text) -> shingles of many documents, sorted; empty for small tables."""
    some = sets(docs.where(F.pmod("row", F.lit(SAMPLE)) == 0), "row")
    found = some.select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    found = ws.write(found, "common").orderBy(F.desc("n"), "x").limit(MOST).select("x").toArrow()["x"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def marks(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """docs(doc_id, row, text) -> (doc_id, row, fp: digest of the set, n: its size, sim: the text's fingerprint of simhash, first: array<bigint>)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column(2).to_pylist()
                each = [shingles(t) for t in texts]
                sim = simhash.fold([simhash.hashes(t) for t in texts]).view(np.int64)
                fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in each], np.uint64).view(np.int64)
                n = pa.array([len(s) for s in each], pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fp), n, pa.array(sim), _lists([first(s, common) for s in each])], ["doc_id", "row", "fp", "n", "sim", "first"])

    return docs.select("doc_id", "row", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, row bigint, fp bigint, n int, sim bigint, first array<bigint>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, n), sorted by (key, fp), without repeats and without keys of one fp."""
    last = None  # the latest distinct row, and whether its key had another before it
    for b in batches:
        if not b.num_rows:
            continue
        key, fp, n = (c.to_numpy() for c in b.columns)
        if last is not None:
            key, fp, n = np.append(last[0], key), np.append(last[1], fp), np.append(last[2], n)
        new = np.append(True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]))
        key, fp, n = key[new], fp[new], n[new]
        same = key[1:] == key[:-1]
        keep = np.append(last is not None and last[3], same) | np.append(same, False)
        seen = bool(keep[-1])
        # The last row waits: what follows may be its key's second.
        out = keep[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][out]), pa.array(fp[:-1][out]), pa.array(n[:-1][out])], ["key", "fp", "n"])
        last = key[-1:], fp[-1:], n[-1:], seen
    if last is not None and last[3]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last[:3]], ["key", "fp", "n"])


def _apart(t: pa.Table) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of pairs (a, b) of rows of t those of two components that sizes and sketches let reach the limit."""
    root, n, bits = t["root"].to_numpy(), t["n"].to_numpy().astype(np.int64), t["bits"].to_pylist()
    size = np.array([len(x) for x in bits], np.int64)
    place, tables = {}, {}
    for wide in np.unique(size).tolist():
        # Sizes at the limit differ by a quarter at most, so sketches by one halving.
        own, longer = np.flatnonzero(size == wide), np.flatnonzero(size == 2 * wide)
        halves = np.frombuffer(b"".join(bits[i] for i in longer), np.uint64).reshape(-1, 2, wide // 8)
        tables[wide] = np.concatenate([np.frombuffer(b"".join(bits[i] for i in own), np.uint64).reshape(-1, wide // 8), halves[:, 0] ^ halves[:, 1]])
        place[wide] = np.zeros(len(size), np.int64)
        place[wide][np.concatenate([own, longer])] = np.arange(len(own) + len(longer))

    def apart(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        two = root[a] != root[b]
        a, b = a[two], b[two]
        sized = WHOLE * np.minimum(n[a], n[b]) >= PART * np.maximum(n[a], n[b])
        a, b = a[sized], b[sized]
        far, short = np.zeros(len(a), np.int64), np.minimum(size[a], size[b])
        for wide, table in tables.items():
            these = np.flatnonzero(short == wide)
            for at in range(0, len(these), max(STEP // wide, 1)):
                some = these[at : at + max(STEP // wide, 1)]
                far[some] = np.bitwise_count(table[place[wide][a[some]]] ^ table[place[wide][b[some]]]).sum(axis=1, dtype=np.int64)
        near = (PART + WHOLE) * (n[a] + n[b] - far) >= 2 * PART * (n[a] + n[b])
        return a[near], b[near]

    return apart


def _with_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, nth): of each the first of its key's PIVOTS that may reach the limit, as (fp, pivot, nth: the pivot's)."""
    held: pa.Table | None = None  # the pivots of the last key
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            new = pa.Table.from_batches([b.slice(at, 4096)])
            t = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            key, place = t["key"].to_numpy(), np.arange(t.num_rows)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            start = np.repeat(starts, np.diff(np.append(starts, t.num_rows)))
            pivot, apart = np.full(t.num_rows, -1), _apart(t)
            for p in range(PIVOTS):
                fresh = place[(start + p < place) & (place >= t.num_rows - new.num_rows) & (pivot < 0)]
                met, one = apart(start[fresh] + p, fresh)
                pivot[one] = met
            one = np.flatnonzero(pivot >= 0)
            fp, nth = t["fp"].to_numpy(), t["nth"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(fp[one]), pa.array(fp[pivot[one]]), pa.array(nth[pivot[one]])], ["fp", "pivot", "nth"])
            held = t.slice(int(starts[-1]), PIVOTS)


def _lags(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows sorted by (key, tile): all pairs of a tile, of one chunk only where the tile is that chunk's own."""
    key, tile, chunk, own = (t[c].to_numpy() for c in ("key", "tile", "chunk", "own"))
    group = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])))
    left = np.arange(t.num_rows)
    for lag in range(1, t.num_rows):
        left = left[left + lag < t.num_rows]
        left = left[group[left] == group[left + lag]]
        if not len(left):
            return
        a = left[own[left] | (chunk[left] != chunk[left + lag])]
        yield a, a + lag


def _tie(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """The larger root goes to the smaller, then paths are shortened."""
    while len(a):
        a, b = label[a], label[b]
        two = a != b
        a, b = a[two], b[two]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, tile): a spanning forest (a, b) of the tile's pairs that sizes and sketches let reach the limit."""
    for t in simhash.whole_groups(batches):
        fp, label, apart = t["fp"].to_numpy(), np.arange(t.num_rows), _apart(t)
        for a, b in _lags(t):
            two = label[a] != label[b]
            _tie(label, *apart(a[two], b[two]))
        moved = np.flatnonzero(label != np.arange(t.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["a", "b"])


def _at_limit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, tile), with whole sets: pairs (a, b) at the limit that tie all components which the tile's pairs tie."""
    for t in simhash.whole_groups(batches):
        fp, apart, each, found = t["fp"].to_numpy(), _apart(t), t["s"].combine_chunks(), []
        each = each.chunk(0) if isinstance(each, pa.ChunkedArray) else each
        ends, flat = each.offsets.to_numpy(), each.flatten().to_numpy().view(np.uint64)
        ends = ends - ends[0]
        _, first_, same = np.unique(t["root"].to_numpy(), return_index=True, return_inverse=True)
        label = first_[same]  # of a component: its first row
        for a, b in _lags(t):
            two = label[a] != label[b]
            for i, j in zip(*(x.tolist() for x in apart(a[two], b[two]))):
                if label[i] == label[j]:
                    continue
                mine, other = flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]]
                met = int((mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other).sum())
                if (PART + WHOLE) * met >= PART * (len(mine) + len(other)):
                    found.append(sorted((int(fp[i]), int(fp[j]))))
                    label[label == max(label[i], label[j])] = min(label[i], label[j])
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, and the texts of both) to the pairs (a, b) at the limit."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            near, last, mine = [], None, None
            for x, text, other in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if x != last:
                    last, mine = x, shingles(text)
                found = shingles(other)
                met = len(np.intersect1d(mine, found, assume_unique=True))
                near.append((PART + WHOLE) * met >= PART * (len(mine) + len(found)))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(near, pa.bool_()))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def fingerprint_pairs(marked: DataFrame, ws: Workspace, tile: int = TILE) -> DataFrame:
    """marked(fp, sim) -> pairs (a, b) of fps whose fingerprints are equal, or linked by simhash's pivot table, a forest of them."""
    held = marked.select("fp", "sim").distinct()
    rep = ws.write(held.groupBy("sim").agg(F.min("fp").alias("rep")), "sims")
    near = simhash.links(rep.select(F.col("sim").alias("fp")), ws, tile)
    tied = near.join(rep.select(F.col("sim").alias("a"), F.col("rep").alias("p")), "a").join(rep.select(F.col("sim").alias("b"), F.col("rep").alias("q")), "b")
    return held.join(rep, "sim").select(*_ordered("fp", "rep")).union(tied.select(*_ordered("p", "q"))).where("a < b")


def shared_rows(marked: DataFrame) -> DataFrame:
    """marked(fp, n, first) -> (key, fp, n) of the first shingles that several texts share."""
    rows = marked.select(F.explode("first").alias("key"), "fp", "n").repartition("key").sortWithinPartitions("key", "fp")
    return rows.mapInArrow(_shared, "key bigint, fp bigint, n int")


def one_key_a_set(shared: DataFrame) -> DataFrame:
    """shared(key, fp, n) without keys whose texts are those of another key; all pairs stay. Sets of texts are told apart by 128 bits."""
    each = shared.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"))
    return shared.join(each.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _dealt(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows(key, fp, ...) of keys(key, chunks), in tiles."""
    # Chunk c of m meets every chunk once: it goes to tiles (c, d) and (d, c), named low * m + high.
    split = rows.join(keys, "key").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = split.select("*", F.explode(F.expr("sequence(0, chunks - 1)")).alias("d"))
    return dealt.withColumn("tile", F.least("chunk", "d") * F.col("chunks") + F.greatest("chunk", "d")).withColumn("own", F.col("chunk") == F.col("d"))


def _by_tile(dealt: DataFrame, *columns: str) -> DataFrame:
    return dealt.select("key", "tile", "chunk", "own", "fp", "n", "root", "bits", *columns).repartition("key", "tile").sortWithinPartitions("key", "tile")


def links(docs: DataFrame, marked: DataFrame, shared: DataFrame, ws: Workspace, tile: int = TILE) -> DataFrame:
    """Edges (a, b) of fps whose components are those of all pairs at the limit.

    docs(doc_id, row, text), marked(doc_id, row, fp, sim) of marks() over them and shared of shared_rows().
    """
    # One row's text for each fp that may have a partner.
    one = marked.join(shared.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("m"))
    one = one.select("fp", F.col("m.doc_id").alias("id"), F.col("m.row").alias("r"))
    texts = docs.join(one, docs["doc_id"].eqNullSafe(F.col("id")) & (docs["row"] == F.col("r"))).select("fp", "text").dropDuplicates(["fp"])
    texts = ws.write(texts, "texts")
    sketches = ws.write(sets(texts, "fp").select("fp", "bits"), "sketches")
    placed, edges = shared.withColumn("root", F.col("fp")), None

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        a, b = texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")), texts.select(F.col("fp").alias("b"), F.col("text").alias("tb"))
        both = ws.write(pairs.distinct(), f"{name}-pairs").join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
        return ws.write(both.mapInArrow(_alike, "a bigint, b bigint"), name)

    def open_keys() -> DataFrame:
        """(key, n: its rows) of keys with rows of two components or more."""
        return placed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "n")

    for i in range(ROUNDS + 1):
        if not i:
            pairs = fingerprint_pairs(marked, ws, tile)
        else:
            rows = placed.join(open_keys().select("key"), "key", "left_semi").join(sketches, "fp")
            rows = rows.withColumn("nth", F.xxhash64("fp", F.lit(i - 1))).repartition("key").sortWithinPartitions("key", "nth")
            met = rows.select("key", "fp", "n", "root", "bits", "nth").mapInArrow(_with_pivots, "fp bigint, pivot bigint, nth bigint")
            pairs = met.groupBy("fp").agg(F.min_by("pivot", "nth").alias("pivot")).select(*_ordered("fp", "pivot"))
        more = similar(pairs, f"near{i}")
        if i and more.isEmpty():
            break
        edges = more if edges is None else edges.union(more)
        roots = components(edges, ws, small=SMALL).select(F.col("node").alias("fp"), "root")
        placed = ws.write(shared.join(roots, "fp", "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root")), f"placed{i}")
        ws.drop(f"placed{i - 1}")
    half = tile // 2
    keys = open_keys().select("key", F.when(F.col("n") > tile, F.ceil(F.col("n") / half)).otherwise(1).cast("int").alias("chunks"))
    may = ws.write(_by_tile(_dealt(placed, keys).join(sketches, "fp")).mapInArrow(_in_tiles, "a bigint, b bigint"), "may")
    # Every pair that sketches allow lies in one component of theirs.
    classes = components(may, ws, small=SMALL).select(F.col("node").alias("fp"), F.col("root").alias("class"))
    members = ws.write(placed.select("fp", "n", "root").distinct().join(classes, "fp").withColumnRenamed("class", "key"), "members")
    size = members.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("weight"))
    keys = size.select("key", F.when((F.col("c") > tile) | (F.col("weight") > WEIGHT), F.ceil(F.greatest(F.col("c") / half, F.col("weight") / (WEIGHT // 2)))).otherwise(1).cast("int").alias("chunks"))
    whole = sets(texts.join(members.select("fp"), "fp", "left_semi"), "fp")
    last = ws.write(_by_tile(_dealt(members, keys).join(whole, "fp"), "s").mapInArrow(_at_limit, "a bigint, b bigint"), "near-last")
    ws.drop("sims", "pivots", "hot", "shared", "texts", "sketches", "may", "members", f"placed{i}", f"placed{i - 1}")
    return edges.union(last)


def keep_one(docs: DataFrame, ws: Workspace, tile: int = TILE) -> DataFrame:
    """docs, same columns: one document of each component stays, chosen as simhash.keep_one() does."""
    ws = ws.tidy()
    content = simhash.content(docs)
    slim = docs.select("doc_id", content.alias("row"), "text")
    full = ws.write(marks(slim, common_shingles(slim, ws)), "marked")
    every = ws.write(shared_rows(full), "every")
    marked = ws.write(full.select("doc_id", "row", "fp", "sim"), "slim")
    ws.drop("common", "marked")  # the first shingles take much disk
    shared = ws.write(one_key_a_set(every), "shared")
    ws.drop("every")
    kept = simhash.one_of_each(docs, marked.select("doc_id", "row", "fp"), links(slim, marked, shared, ws, tile), ws)
    ws.drop("slim")
    return kept
