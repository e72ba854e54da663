"""What the corpus operators share: table access, shared-folder tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from copy import copy

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none and runs on one machine a folder of our own is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rulespan-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """Parquet tables under one fresh folder of the shared directory.

    A written table cuts lineage and survives lost executors. drop() removes one that
    nothing reads any more; what the returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.tidies = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", False

    def tidy(self) -> Workspace:
        """The same folder, where a write ends with the removal of its shuffle files; else they wait for the driver's garbage collector."""
        out = copy(self)
        out.tidies = True
        return out

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, "false")
        if self.tidies:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").options(**options).parquet(f"{self.root}/{name}")
        finally:
            if self.tidies:
                self.spark.conf.set(CLEANUP, before)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def arrow_type(kind: str) -> pa.DataType:
    return pa.list_(ARROW[kind[6:-1]]) if kind.startswith("array<") else ARROW[kind]


def map_rows(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: dict[str, str], pass_rows: int = 4096) -> DataFrame:
    """rows(*columns as Python lists) -> tuples of schema, over Arrow batches; no shuffle.

    Batches are cut to pass_rows rows so that a worker holds few Python strings at once.
    """
    names, kinds = list(schema), [arrow_type(k) for k in schema.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, pass_rows):
                batch = whole.slice(at, pass_rows)
                found = list(rows(*(c.to_pylist() for c in batch.columns)))
                columns = list(zip(*found)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return df.mapInArrow(run, ", ".join(f"`{n}` {k.replace('long', 'bigint')}" for n, k in schema.items()))
