"""Parquet tables of one evaluation in the shared folder: they cut lineage and survive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a session on one machine has none (tests) a folder of our own is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rulespan-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/eval-{uuid.uuid4().hex[:12]}", 0

    def write(self, df: DataFrame) -> str:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return path

    def read(self, df_schema, *paths: str) -> DataFrame:
        return self.spark.read.schema(df_schema).parquet(*paths)

    def delete(self, *paths: str) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        for p in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
