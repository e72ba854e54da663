"""Training order: a keyed Feistel permutation gives every sequence its global slot.

Texts are tokenized once, closed by an end id, joined in scan order within a task and cut into
records of `length` 16-bit ids, which go to a table; a task's last record is filled up with
end ids. Counting that table numbers the records: record `nth` of task t has the number
(records of earlier tasks) + nth, of N in all. Its slot is permute(number, N): a balanced
Feistel network over the least even number of bits that holds [0, N), walked on (permuted
again) while the value is outside. Keyed by `key`, it needs no table and no sort of random
numbers, and permute(slot, N, inverse=True) gives the number back.

Shard k holds the slots from k * per_shard on, each of 2 * length bytes, so a slot's file and
offset follow from the slot alone and reads are sequential and resume anywhere; only the last
shard may be shorter. A partition of the order is a run of whole shards: as many partitions as
shards, PARTITIONS at most. A file appears whole or not at all. Records are compressed one by
one on their way through the shuffle. Each task's first number is sent with the tasks, eight
bytes an input split.

Where records are cut depends on the input splits; the table of records fixes it before
anything is numbered, so lost executors and retries change nothing.

Defined results: null and empty texts are one end id; repeated rows are repeated; other
columns are ignored; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .flat import Writer

TOKENIZER, END = "byte_bpe_multi_50k.tiktoken", 50256
LENGTH, PER_SHARD, KEY = 1024, 4096, 20_240_501
ROUNDS = 6
PARTITIONS = 50_000  # of the order, at most
CUT = 512  # records that a batch holds
SQUEEZED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "5", "parquet.enable.dictionary": "false"}


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A round function: SplitMix64's finaliser."""
    x = x + np.uint64(key * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def permute(numbers: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of [0, n), or its inverse, elementwise."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    x = numbers.astype(np.uint64)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for r in range(ROUNDS)[:: -1 if inverse else 1]:
            k = key * ROUNDS + r
            if inverse:
                left, right = right ^ (_mix(left, k) & low), left
            else:
                left, right = right, left ^ (_mix(right, k) & low)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]  # cycle-walking
    return out.astype(np.int64)


@lru_cache(maxsize=1)
def _encoding(name: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(name if name.startswith("/") else public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, tokenizer: str = TOKENIZER, end: int = END) -> np.ndarray:
    """The whole text's 16-bit ids and the end id."""
    ids = _encoding(tokenizer).encode_to_numpy(text, disallowed_special=()) if text else ()
    out = np.empty(len(ids) + 1, "<u2")
    out[:-1], out[-1] = ids, end
    return out


def records(texts: Iterator[str | None], tokenizer: str, end: int, length: int) -> Iterator[bytes]:
    """Fixed-length records of the joined ids; no more than one text and one record are held."""
    held = np.empty(0, "<u2")
    for t in texts:
        held = np.concatenate([held, encode(t, tokenizer, end)])
        whole = len(held) // length * length
        for a in range(0, whole, length):
            yield held[a : a + length].tobytes()
        held = held[whole:]
    if len(held):
        yield np.concatenate([held, np.full(length - len(held), end, "<u2")]).tobytes()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str | None]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            yield from whole.column(0).slice(at, 256).to_pylist()


def materialise(docs: DataFrame, ws: Workspace, tokenizer: str = TOKENIZER, end: int = END, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, partitions: int = PARTITIONS) -> DataFrame:
    """Writes shards under the workspace; one row a sequence: slot, shard (file), byte_offset, task, nth, ids_crc32.

    partitions: of the order at most. The shards stay until their folder is deleted.
    """
    folder, stride = f"{ws.root}/shards", 2 * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), 0
        stream = records(_texts(batches), tokenizer, end, length)
        while some := list(islice(stream, CUT)):
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(some), pa.int32()), pa.array(range(nth, nth + len(some)), pa.int64()), pa.array(some, pa.binary())], ["task", "nth", "ids"])
            nth += len(some)

    made = ws.write(docs.select("text").mapInArrow(cut, "task int, nth bigint, ids binary"), "records", **SQUEEZED)
    counts = sorted(made.groupBy("task").agg(F.count("*").alias("n")).collect())  # one row an input split
    tasks, sizes = np.array(counts, np.int64).reshape(-1, 2).T
    first, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    shards = -(-total // per_shard)
    run = max(1, -(-shards // partitions)) * per_shard  # slots of a partition

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for at in range(0, whole.num_rows, CUT):
                b = whole.slice(at, CUT)
                nth = b.column(1).to_numpy()
                slots = permute(first[np.searchsorted(tasks, b.column(0).to_numpy())] + nth, total, key)
                ids = pa.array([squeeze(x) for x in b.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array((slots // run).astype(np.int32)), b.column(0), b.column(1), ids], ["slot", "part", "task", "nth", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, shard, expand = None, -1, "", zstandard.ZstdDecompressor().decompress
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        try:
            for b in batches:
                rows = []
                for slot, task, nth, packed in zip(*(b.column(c).to_pylist() for c in ("slot", "task", "nth", "ids"))):
                    if slot // per_shard != now:
                        if out is not None:
                            out.commit()
                        now = slot // per_shard
                        shard = f"shard-{now:09d}.bin"
                        out = Writer(f"{folder}/{shard}")
                    if out.size != slot % per_shard * stride:
                        raise ValueError(f"slot {slot} is not the next of {shard}")
                    ids = expand(packed)
                    rows.append((slot, shard, out.size, task, nth, zlib.crc32(ids)))
                    out.write(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], ["slot", "shard", "byte_offset", "task", "nth", "ids_crc32"])
            if out is not None:
                out.commit()
                out = None
        finally:
            if out is not None:
                out.abort()

    dealt = made.mapInArrow(deal, "slot bigint, part int, task int, nth bigint, ids binary")
    ordered = dealt.repartitionById(max(1, -(-total // run)), F.col("part")).sortWithinPartitions("slot")
    written = ws.write(ordered.mapInArrow(write, "slot bigint, shard string, byte_offset bigint, task int, nth bigint, ids_crc32 bigint"), "index")
    ws.drop("records")
    return written
