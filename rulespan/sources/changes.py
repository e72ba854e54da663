"""Change tables: rows with _time and _diff, in batches; the current state is the rows whose diffs add up to more than 0."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = ("_time", "_diff")


def consolidate(changes: DataFrame, by_time: bool = False) -> DataFrame:
    """Diffs added up by row (and time); zero sums go. Partial sums are combined before the shuffle."""
    keys = [c for c in changes.columns if c not in META] + (["_time"] if by_time else [])
    return changes.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.sum("_diff").alias("_diff")).where("_diff <> 0")


def current(changes: DataFrame, until: int | None = None) -> DataFrame:
    """The rows present, as a set, at time `until` or now."""
    if until is not None:
        changes = changes.where(F.col("_time") <= until)
    return consolidate(changes).where("_diff > 0").drop("_diff")


PART = re.compile(r"(batch|base)-(\d+)(?:-(.+)-(\d+))?")


@dataclass(frozen=True)
class Part:
    """A folder of the table: a batch, or a base that stands for all parts up to its place."""

    kind: str
    place: int
    source: str | None = None
    number: int = -1

    @property
    def folder(self) -> str:
        return f"{self.kind}-{self.place:012d}" + (f"-{self.source}-{self.number}" if self.source else "")


class ChangeTable:
    """Changes as Parquet: a folder a batch, and a base that compaction makes of what came before.

    One writer. A folder counts once it is whole, so readers see whole batches and a batch or
    compaction that was cut short leaves no trace. A batch of a source carries its number and
    is taken once, across restarts and compactions. What a base replaces stays until the next
    compaction, for those who read it still.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _every(self) -> list[Part]:
        """Whole parts in order of place; a base after the batch of its place."""
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        found = [m for x in fs.listStatus(path) if (m := PART.fullmatch(x.getPath().getName())) and fs.exists(self._fs(m[0], "rows", "_SUCCESS")[1])]
        return sorted((Part(m[1], int(m[2]), m[3], int(m[4] or -1)) for m in found), key=lambda x: (x.place, x.kind != "batch"))

    def _live(self) -> list[Part]:
        every = self._every()
        last = max((i for i, x in enumerate(every) if x.kind == "base"), default=0)
        return every[last:]

    def taken(self, source: str) -> int:
        """The greatest number of a batch of this source, -1 if there is none."""
        return max(self._taken().get(source, -1), -1)

    def _taken(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for x in self._live():
            if x.kind == "base":
                out |= {r[0]: r[1] for r in self.spark.read.parquet(f"{self.path}/{x.folder}/taken").collect()}  # a row a source
            elif x.source:
                out[x.source] = max(out.get(x.source, -1), x.number)
        return out

    def append(self, rows: DataFrame, diff: int = 1, time: int = 0) -> None:
        self.append_changes(rows.withColumns({"_time": F.lit(time).cast("bigint"), "_diff": F.lit(diff).cast("bigint")}))

    def append_changes(self, changes: DataFrame, source: str | None = None, number: int = -1) -> bool:
        """Whether the batch is new; one of a source whose number was taken is left out."""
        if source is not None and number <= self.taken(source):
            return False
        place = max((x.place for x in self._every()), default=-1) + 1
        changes.write.mode("overwrite").parquet(f"{self.path}/{Part('batch', place, source, number).folder}/rows")
        return True

    def exists(self) -> bool:
        return bool(self._live())

    def read(self, since: int | None = None) -> DataFrame:
        """Changes after `since`; the filter reaches the Parquet row groups."""
        df = self.spark.read.parquet(*[f"{self.path}/{x.folder}/rows" for x in self._live()])
        return df.where(F.col("_time") > since) if since is not None else df

    def state(self, until: int | None = None) -> DataFrame:
        return current(self.read(), until)

    def compact(self, before: int) -> None:
        """A base in which changes up to `before` are consolidated; later ones stay as they are."""
        live, every = self._live(), self._every()
        if not live:
            return
        df = self.read()
        old = consolidate(df.where(F.col("_time") <= before)).withColumn("_time", F.lit(before).cast("bigint"))
        fresh = old.select(*df.columns).unionByName(df.where(F.col("_time") > before))
        base = f"{self.path}/{Part('base', live[-1].place + 1).folder}"
        self.spark.createDataFrame(list(self._taken().items()), "source string, number bigint").write.mode("overwrite").parquet(f"{base}/taken")
        fresh.write.mode("overwrite").parquet(f"{base}/rows")  # the base counts from here on
        for x in every:
            if x not in live:
                fs, path = self._fs(x.folder)
                fs.delete(path, True)

    def delete(self) -> None:
        fs, path = self._fs()
        fs.delete(path, True)
