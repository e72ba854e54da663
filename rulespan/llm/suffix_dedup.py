"""Exact substring dedup: bytes of every 400-byte string that occurs elsewhere are removed.

A corpus-wide suffix array would not fit a task, and shards cut by document would not see
each other's repeats. So shards are cut by content. The least hash of the 50-byte grams of a
400-byte window is its anchor; equal windows have equal anchors at equal distances, so all
occurrences of a repeated window meet in the shard of its anchor's hash. What travels is the
stretch of windows that share an anchor (about 575 bytes). In a shard:

* Equal stretches collapse to one with a count; a count of two or more repeats all of it.
* Anchors that occur once in the corpus are dropped by an aggregate of hashes, before any
  text moves.
* The rest is suffix-sorted by induced sorting (sais.py), prefixes common to neighbours are
  computed in permuted order, and runs of suffixes sharing 400 bytes from two places or more
  are repeats.
* An anchor with more than HOT distinct stretches (one passage in very many contexts) would
  make a shard grow with the corpus. Its stretches are cut into blocks of GRID window starts,
  aligned to the anchor, whose 128-bit digests are counted with map-side combining: a block
  that occurs again is repeated, one whose core (the bytes all its windows share) does not
  occur again is not, and only the blocks between, at a passage's ends, count windows singly.

Strings are judged on the input, so removal order does not matter. Rows are told apart by
their place in the scan; when a text is read again for its stretches its hash is compared,
and a changed input fails the job.

Defined results: a null text is empty; texts under 400 bytes lose nothing; repeated rows and
repeated ids are separate documents, which repeat each other; null ids are kept; other
columns are ignored; an empty table gives none. A text is handled in one task in pieces of
1 MB, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, map_rows
from .sais import common_prefixes, suffix_array

WINDOW = 400  # bytes
GRAM = 50  # bytes hashed for an anchor
PIECE = 1 << 20  # window starts handled at once
SHARD = 1 << 20  # bytes suffix-sorted at once
HOT = 128  # distinct stretches of one anchor in a shard
GRID = 16  # window starts in a block of a hot anchor
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverses modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        m = min(max(n, 1 << 14) * 2, PIECE + WINDOW + 1)
        m = max(m, n)
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            _powers[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(m - 1, b, np.uint64), dtype=np.uint64)])
    return _powers["up"], _powers["down"]


def stretches(x: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, last, anchor hash, anchor place) of runs of windows of x that share an anchor; len(x) >= window."""
    n, w = len(x), window - gram + 1
    up, down = _power(n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # The place in the low bits makes the leftmost of equal hashes the least, and can be read back.
    low = np.uint64((1 << 21) - 1)
    keys = h & ~low | np.arange(len(h), dtype=np.uint64)
    m = -(-len(keys) // w) * w
    blocks = np.concatenate([keys, np.full(m - len(keys), np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - window + 1
    at = (np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts]) & low).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.concatenate([first[1:], [starts]]) - 1
    return first, last, h[at[first]], at[first]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of window starts, inclusive, sorted and joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def survey(data: bytes, window: int = WINDOW) -> tuple[dict[tuple[int, int], list[int]], list[tuple[int, int]]]:
    """(anchor hash, stretch digest) -> [count, first start, last start], and ranges repeated within the text by equal stretches."""
    found: dict[tuple[int, int], list[int]] = {}
    where: dict[tuple[int, int], list[tuple[int, int]]] = {}
    digest = xxhash.xxh3_64_intdigest
    for at in range(0, max(len(data) - window + 1, 0), PIECE):
        piece = data[at : at + PIECE + window - 1]
        for a, b, h, _ in zip(*(v.tolist() for v in stretches(np.frombuffer(piece, np.uint8), window))):
            key = (h, digest(piece[a : b + window]))
            if (f := found.get(key)) is None:
                found[key] = [1, at + a, at + b]
            else:
                f[0] += 1
                where.setdefault(key, [(f[1], f[2])]).append((at + a, at + b))
    return found, merged([s for v in where.values() for s in v])


def _surveyed(docs: DataFrame, window: int) -> DataFrame:
    def rows(places, ids, texts):
        for u, i, t in zip(places, ids, texts):
            data = (t or "").encode()
            found, own = survey(data, window)
            yield u, i, len(data), hashlib.sha256(data).hexdigest(), _signed(xxhash.xxh3_64_intdigest(data)), [x for s in own for x in s], [_signed(h) for h, _ in found], [_signed(d) for _, d in found], [f[0] for f in found.values()], [f[1] for f in found.values()], [f[2] for f in found.values()]

    schema = {"u": "long", "doc_id": "long", "n_bytes": "long", "sha256": "string", "check": "long", "own": "array<long>", "h": "array<long>", "d": "array<long>", "c": "array<long>", "a": "array<long>", "b": "array<long>"}
    return map_rows(docs, rows, schema, pass_rows=512)


def shard_repeats(parts: list[tuple[int, int, bytes]], window: int = WINDOW) -> list[tuple[int, int]]:
    """parts (row, place, bytes) -> (row, start) of every window that occurs at two (row, start) or more among them."""
    joined = bytearray()
    owner, place = [], []
    for _, _, piece in parts:
        joined += piece + b"\xff"  # no byte of UTF-8
    raw = np.frombuffer(bytes(joined), np.uint8)
    sizes = np.array([len(p) + 1 for _, _, p in parts])
    ends = np.cumsum(sizes)
    part = np.repeat(np.arange(len(parts)), sizes)
    rest = ends[part] - 1 - np.arange(len(raw))  # bytes to the end of the own part
    rows, row = np.unique(np.array([u for u, _, _ in parts], np.int64), return_inverse=True)
    start = np.array([a for _, a, _ in parts], np.int64)[part] + np.arange(len(raw)) - (ends - sizes)[part]
    sa = suffix_array(np.concatenate([raw.astype(np.int64) + 1, [0]]), 257)[1:]
    shared = common_prefixes(raw, sa)[sa]
    shared = np.minimum(shared, np.minimum(rest[sa], np.concatenate([[0], rest[sa[:-1]]])))
    first = np.flatnonzero(shared < window)  # a run of suffixes that share a window begins
    origin = (row[part] << 40 | start)[sa]
    several = np.minimum.reduceat(origin, first) != np.maximum.reduceat(origin, first)
    hit = np.unique(origin[np.repeat(several, np.diff(np.concatenate([first, [len(sa)]])))])
    return list(zip(rows[hit >> 40].tolist(), (hit & (1 << 40) - 1).tolist()))


def _ranges(hits: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Sorted (row, start) to (row, first start, last start)."""
    a = None
    for u, s in hits:
        if a is not None and (u, s) == (a[0], a[2] + 1):
            a[2] = s
            continue
        if a is not None:
            yield tuple(a)
        a = [u, s, s]
    if a is not None:
        yield tuple(a)


def _suffix_sorted(window: int):
    names = ["u", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, last = 0, None

        def flush():
            out = list(_ranges(shard_repeats([(u, a, p) for _, u, a, p in held], window)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], names)

        for batch in batches:
            for h, u, a, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD and h != last:  # an anchor's stretches stay together
                    yield flush()
                    size = 0
                held.append((h, u, a, piece))
                size, last = size + len(piece), h
        if held:
            yield flush()

    return run


def repeats(docs: DataFrame, ws: Workspace, window: int = WINDOW, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """docs(u, doc_id, text) -> (surveyed rows, ranges (u, a, b) of repeated window starts)."""
    base = ws.write(_surveyed(docs, window), "base")
    anchors = base.select("u", F.explode(F.arrays_zip("h", "d", "c", "a", "b")).alias("x")).select("u", "x.*")
    by_stretch = anchors.groupBy("h", "d").agg(F.sum("c").alias("n"), F.min(F.struct("u", "a", "b")).alias("one"))
    by_anchor = by_stretch.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    shared = ws.write(by_stretch.join(by_anchor, "h").select("h", "d", "n", "one", "kinds"), "shared")
    equal = anchors.join(shared.where("n > 1").select("h", "d"), ["h", "d"]).select("u", "a", "b")

    wanted = shared.where("kinds > 1").select("h", "kinds", "one.*").groupBy("u").agg(F.collect_list(F.struct("h", "a", "b", (F.col("kinds") > hot).alias("hot"))).alias("wanted"))
    wanted = wanted.join(base.select("u", "check"), "u")

    def cut(places, checks, wants, texts):
        for u, check, want, t in zip(places, checks, wants, texts):
            data = t.encode()
            if _signed(xxhash.xxh3_64_intdigest(data)) != check:
                raise RuntimeError(f"row {u} changed between two reads of the input")
            for w in want:
                yield w["h"], u, w["a"], w["hot"], data[w["a"] : w["b"] + window]

    parts = map_rows(wanted.join(docs.select("u", "text"), "u").select("u", "check", "wanted", "text"), cut, {"h": "long", "u": "long", "a": "long", "hot": "boolean", "part": "binary"}, pass_rows=256)
    parts = ws.write(parts, "parts")
    sorted_ = parts.where("not hot").select("h", "u", "a", "part").repartition("h").sortWithinPartitions("h").mapInArrow(_suffix_sorted(window), "u bigint, a bigint, b bigint")

    crowded = parts.where("hot").select("u", "a", "part")
    if crowded.isEmpty():
        return base, equal.union(sorted_)
    return base, equal.union(sorted_).union(_crowded(crowded, ws, window))


def _two(data: bytes) -> tuple[int, int]:
    w = xxhash.xxh3_128_intdigest(data)
    return _signed(w >> 64), _signed(w & (1 << 64) - 1)


def grid(part: bytes, window: int = WINDOW) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(first start, last start, block bytes, core bytes) of a stretch's blocks; both begin with the block's number.

    Blocks are cut by distance from the anchor, so equal windows lie in blocks of one number.
    A block cut short by the stretch's end has the core of the whole one: a stretch holds it.
    """
    _, last, _, place = stretches(np.frombuffer(part, np.uint8), window)
    shift, end = (window - int(place[0])) % GRID, int(last[-1])
    at = 0
    while at <= end:
        first = at - (at + shift) % GRID  # of the whole block
        to = min(first + GRID - 1, end)
        number = b"%d:" % ((first - int(place[0])) // GRID)
        yield at, to, number + b"%d:" % (at - first) + part[at : to + window], number + part[first + GRID - 1 : first + window]
        at = to + 1


def _crowded(parts: DataFrame, ws: Workspace, window: int) -> DataFrame:
    """parts(u, a, part) of hot anchors to repeated ranges (u, a, b)."""

    def cut(places, starts, texts):
        for u, a, p in zip(places, starts, texts):
            for first, last, block, core in grid(p, window):
                yield u, a, first, last, *_two(block), *_two(core)

    schema = {"u": "long", "a": "long", "first": "long", "last": "long", "x": "long", "y": "long", "cx": "long", "cy": "long"}
    blocks = ws.write(map_rows(parts, cut, schema, pass_rows=256), "blocks")
    # Equal blocks collapse to one with a count; cores that several kinds of block share are looked into.
    kinds = ws.write(blocks.groupBy("cx", "cy", "x", "y").agg(F.count("*").alias("n"), F.min(F.struct("u", "a", "first", "last")).alias("one")), "kinds")
    again = kinds.where("n > 1").select("x", "y")
    shared = kinds.groupBy("cx", "cy").agg(F.count("*").alias("n")).where("n > 1").select("cx", "cy")
    whole = blocks.join(again, ["x", "y"]).select("u", (F.col("a") + F.col("first")).alias("a"), (F.col("a") + F.col("last")).alias("b"))
    between = kinds.join(shared, ["cx", "cy"]).select("one.*")
    between = between.groupBy("u", "a").agg(F.collect_list(F.struct("first", "last")).alias("open")).join(parts, ["u", "a"]).select("u", "a", "open", "part")

    def digests(places, starts, opens, texts):
        for u, a, want, p in zip(places, starts, opens, texts):
            for w in want:
                for i in range(w["first"], w["last"] + 1):
                    yield *_two(p[i : i + window]), u, a + i

    windows = ws.write(map_rows(between, digests, {"x": "long", "y": "long", "u": "long", "s": "long"}, pass_rows=64), "windows")
    # A start has one anchor, so rows are different places; one block of each kind stands for its equals.
    many = windows.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    return whole.union(windows.join(many, ["x", "y"]).select("u", F.col("s").alias("a"), F.col("s").alias("b")))


def removed_spans(ranges: list[tuple[int, int]], window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start in the ranges."""
    out: list[list[int]] = []
    for a, b in merged(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = b + window
        else:
            out.append([a, b + window])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, ws: Workspace, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row a row of docs (query op3_suffix_dedup)."""
    placed = docs.select(F.monotonically_increasing_id().alias("u"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base, found = repeats(placed, ws, window, hot)
    found = found.union(base.where("size(own) > 0").select("u", F.expr("explode(transform(sequence(0, size(own) div 2 - 1), i -> struct(own[2 * i] as a, own[2 * i + 1] as b)))").alias("x")).select("u", "x.a", "x.b"))
    # A row's ranges are bounded by its own length.
    by_row = ws.write(found.groupBy("u").agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "ranges")

    def finish(places, ranges, texts):
        for u, r, t in zip(places, ranges, texts):
            data = t.encode()
            spans = removed_spans([(x["a"], x["b"]) for x in r], window)
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            yield u, sum(b - a for a, b in spans), len(spans), digest.hexdigest()

    done = map_rows(by_row.join(placed.select("u", "text"), "u").select("u", "ranges", "text"), finish, {"_u": "long", "n_removed": "long", "n_spans": "long", "kept": "string"}, pass_rows=256)
    zero = F.lit(0).cast("bigint")
    return base.join(done, F.col("u") == F.col("_u"), "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256"))
