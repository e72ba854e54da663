"""Token counts of documents from flat, unindexed token files by a separator scan.

A file is 16-bit ids and nothing else; an end-of-document id closes each document. Files are
read in blocks of fixed size, each by any task. A block's task finds its separators in one
vectorised comparison and gives the lengths of the documents that close in it, each counted
from the separator before it; the block's first one lacks what earlier blocks hold. A prefix
scan over block summaries (last separator so far, separators so far) supplies that carry and
each document's ordinal. No task holds more than a block; a document may span many.

Defined results: a document of no ids counts zero; ids after a file's last separator are no
document and are reported by tails(); an empty file or folder gives no rows. For write():
null and empty texts are an end id alone, repeated rows are repeated, null ids are kept,
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace
from .flat import Writer, read_range
from .training_order import END, TOKENIZER, encode

BLOCK = 4 << 20  # bytes; even


def write(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """One flat file a scan task, streamed; rows (doc_id, file, ordinal, size: the file's bytes, on its last row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"tokens-{TaskContext.get().partitionId():08d}.bin"
        out, n = Writer(f"{folder}/{name}"), 0
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    for t in b.column(1).to_pylist():
                        out.write(encode(t, tokenizer, end).tobytes())
                    k = b.num_rows
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * k), pa.array(range(n, n + k), pa.int64()), pa.array([None] * k, pa.int64())], ["doc_id", "file", "ordinal", "size"])
                    n += k
            size = out.commit()
            out = None
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([name]), pa.array([-1], pa.int64()), pa.array([size])], ["doc_id", "file", "ordinal", "size"])
        finally:
            if out is not None:
                out.abort()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, file string, ordinal bigint, size bigint")


def _scan(files: DataFrame, folder: str, end: int, block: int) -> DataFrame:
    """files(file, size) -> a row a block: file, block, first, n_ids, last (place of the last separator in the file or null), lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, size, k in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.frombuffer(read_range(f"{folder}/{file}", k * block, min(block, size - k * block)), "<u2")
                first = k * (block // 2)
                at = np.flatnonzero(ids == end)
                lengths = np.diff(at, prepend=-1) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([k]), pa.array([first]), pa.array([len(ids)]), pa.array([first + int(at[-1]) if len(at) else None], pa.int64()), pa.array([lengths.tolist()], pa.list_(pa.int64()))],
                    ["file", "block", "first", "n_ids", "last", "lengths"],
                )

    blocks = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size - 1) div {block}"))).alias("block"))
    return blocks.repartition("file", "block").mapInArrow(run, "file string, block bigint, first bigint, n_ids bigint, last bigint, lengths array<bigint>")


def counts(files: DataFrame, folder: str, ws: Workspace, end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) of every closed document, the end id not counted."""
    scanned = ws.write(_scan(files, folder, end, block), "scanned")
    # The prefix scan sorts summaries only, a row a block; lengths join it by block.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("before")
    carry = scanned.select("file", "block", "last", F.size("lengths").cast("bigint").alias("closed"))
    carry = carry.select("file", "block", before, F.coalesce(F.sum("closed").over(earlier), F.lit(0)).alias("done"))
    each = scanned.join(carry, ["file", "block"]).select("file", "first", "before", "done", F.posexplode("lengths").alias("i", "n"))
    return each.select("file", (F.col("done") + F.col("i")).alias("ordinal"), F.when(F.col("i") == 0, F.col("n") + F.col("first") - F.col("before") - 1).otherwise(F.col("n")).alias("n_tokens"))


def tails(files: DataFrame, folder: str, ws: Workspace, end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, n_tokens) after a file's last separator, where there are any."""
    scanned = _scan(files, folder, end, block)
    by_file = scanned.groupBy("file").agg(F.max(F.col("first") + F.col("n_ids")).alias("n"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    return by_file.select("file", (F.col("n") - F.col("last") - 1).alias("n_tokens")).where("n_tokens > 0")


def report(spark: SparkSession, docs: DataFrame, ws: Workspace) -> DataFrame:
    """Query op4_token_counts: documents to flat files, and (doc_id, file, ordinal, n_tokens) from scanning those."""
    folder = f"{ws.root}/flat"
    listed = ws.write(write(docs, folder), "listed")
    found = counts(listed.where("ordinal = -1").select("file", "size"), folder, ws)
    return listed.where("ordinal >= 0").select("doc_id", "file", "ordinal").join(found, ["file", "ordinal"])
