"""Best-fit packing of token pieces by linear grouping.

Lengths are integers up to the capacity, so the histogram of lengths has at most `capacity`
rows whatever the corpus; the plan is made from it on the driver and the pieces never are.

1. Large lengths (over capacity / SMALL) are dealt into groups of equal cardinality and rounded
   up to their group's longest.
2. Configurations (multisets of rounded lengths that fit a sequence) are optimised by column
   generation: a simplex over the groups, priced by a knapsack over the capacity.
3. Actual lengths are substituted for the rounded ones, in runs. Sequences that this leaves
   nearly full stand; where rounding left more room than capacity / TIGHT, the pieces go back.
4. Small lengths and those that went back go, longest first, where the gap is tightest.

A plan row says that pieces number lo..lo+n-1 of a length go to n consecutive sequences at
one offset. Pieces get that number from their task, their place in it, and a running sum of
counts over tasks, so no length gathers in one task. Those sums are shuffled to the pieces by
(task, length): there is a row for each such pair, too many to broadcast.

Defined results: a null or empty text is one end-of-document id. Rows are packed one by one
(repeated rows twice, null ids kept); other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .tokens import TOKENIZER, chunks

CAPACITY, END = 2048, 0
SMALL = 4  # lengths up to capacity / SMALL are small
GROUPS = 48
TIGHT = 256


def _price(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: unbounded knapsack over the capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(sizes.min())
    for c in range(least, capacity + 1):
        fits = sizes <= c
        value = np.where(fits, best[np.where(fits, c - sizes, 0)] + worth, -1.0)
        k = int(value.argmax())
        if value[k] > best[c - 1] + 1e-12:
            best[c], last[c] = value[k], k
        else:
            best[c] = best[c - 1]
    take, c = np.zeros(len(sizes), int), capacity
    while c >= least:
        if last[c] < 0:
            c -= 1
        else:
            take[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), take


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[int, np.ndarray]]:
    """(number of sequences, how many of each size) covering counts; near the fewest sequences."""
    s, need = np.array(sizes), np.array(counts, float)
    columns = np.diag(capacity // s).astype(float)
    solution = need / np.diag(columns)
    inverse = np.linalg.inv(columns)
    for _ in range(rounds):
        worth = inverse.sum(axis=0)  # dual prices: c_B B^-1 with unit costs
        value, take = _price(s, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ take
        ratio = np.where(step > 1e-9, solution / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = take
        inverse = np.linalg.inv(columns)
        solution = np.maximum(inverse @ need, 0)
    whole = np.floor(solution + 1e-9).astype(int)
    used = [(int(n), columns[:, j].astype(int)) for j, n in enumerate(whole) if n]
    left = need.astype(int) - sum((n * c for n, c in used), np.zeros(len(s), int))
    left = np.maximum(left, 0)
    order = np.argsort(-s)
    while left.any():  # the fractional rest, first fit decreasing
        room, take = capacity, np.zeros(len(s), int)
        for k in order:
            n = min(int(left[k]), room // int(s[k]))
            take[k], room = n, room - n * int(s[k])
        times = max(1, int(min(left[k] // take[k] for k in np.flatnonzero(take))))
        used.append((times, take))
        left -= times * take
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """Rows (length, lo, n, sequence, offset), by length and lo; sequences are numbered from 0."""
    rows: list[tuple[int, int, int, int, int]] = []
    given: dict[int, int] = defaultdict(int)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, n)
    sequences = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        rows.append((length, given[length], n, sequence, offset))
        given[length] += n

    small = capacity // SMALL
    rest = defaultdict(int, {k: n for k, n in histogram.items() if k <= small and n})
    large = sorted(((k, n) for k, n in histogram.items() if k > small and n), reverse=True)
    if large:
        total = sum(n for _, n in large)
        each = -(-total // min(groups, total))
        runs: list[list[list[int]]] = [[]]  # of each group: [length, n], longest first
        room = each
        for length, n in large:
            while n:
                if not room:
                    runs.append([])
                    room = each
                k = min(n, room)
                runs[-1].append([length, k])
                n, room = n - k, room - k
        by_size: dict[int, list[list[int]]] = {}
        for g in runs:  # groups that round to one size are one
            by_size.setdefault(g[0][0], []).extend(g)
        sizes = list(by_size)
        for n, take in configurations(sizes, [sum(k for _, k in by_size[x]) for x in sizes], capacity):
            todo: list[tuple[int, tuple[int, ...]]] = [(n, ())]  # (sequences, their lengths)
            for size in [x for x, t in zip(sizes, take) for _ in range(int(t))]:
                queue, after = by_size[size], []
                for m, held in todo:
                    while m and queue:
                        length, k = queue[0][0], min(m, queue[0][1])
                        after.append((k, (*held, length)))
                        queue[0][1] -= k
                        if not queue[0][1]:
                            queue.pop(0)
                        m -= k
                    if m:  # more places than pieces
                        after.append((m, held))
                todo = after
            for m, held in todo:
                room = capacity - sum(held)
                if room > capacity // TIGHT:
                    for length in held:
                        rest[length] += m
                    continue
                for i, length in enumerate(held):
                    put(length, m, sequences, sum(held[:i]))
                if room:
                    gaps[room].append((sequences, m))
                sequences += m
    for length in sorted(rest, reverse=True):
        n, room = rest[length], length
        while n:
            while room <= capacity and not gaps[room]:
                room += 1
            if room > capacity:
                more = -(-n // (capacity // length))
                gaps[capacity].append((sequences, more))
                sequences, room = sequences + more, capacity
                continue
            first, m = gaps[room].pop()
            q = room // length
            if n < q:  # all that is left goes to one sequence
                full, q = 1, n
            else:
                full = min(m, n // q)
            for i in range(q):
                put(length, full, first, capacity - room + i * length)
            n -= full * q
            if m > full:
                gaps[room].append((first + full, m - full))
            if room - q * length:
                gaps[room - q * length].append((first, full))
                room = min(room, max(length, room - q * length))
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): nth counts the task's earlier pieces of that length."""
    tail, kind = end.to_bytes(4, "little"), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = defaultdict(int)
        task, encoder, size = TaskContext.get().partitionId(), chunks(tokenizer), 4 * capacity
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
        for whole in batches:
            kinds = [whole.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            for at in range(0, whole.num_rows, 256):
                b, out = whole.slice(at, 256), []
                for doc, data in zip(b.column(0).to_pylist(), encoder.ids(b.column(1).to_pylist())):
                    data += tail
                    for i, a in enumerate(range(0, len(data), size)):
                        part = data[a : a + size]
                        n = len(part) // 4
                        out.append((doc, i, a // 4, n, zlib.crc32(part), task, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint")


def pack(docs: DataFrame, ws: Workspace, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = ws.write(pieces(docs, tokenizer, capacity), "pieces")
    counts = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    counts = ws.write(counts.select("task", "length", "n", before.alias("base")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(histogram, capacity, groups)
    keys = rows[:, 0] << 44 | rows[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("base").to_numpy() + b.column("nth").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            sequence, offset = rows[at, 3] + rank - rows[at, 1], rows[at, 4]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = made.join(counts.drop("n").hint("merge"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "base")
    return numbered.mapInArrow(place, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
