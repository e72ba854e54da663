"""Change feeds: Structured Streaming batches of (row, _diff) into a change table, and views kept up to date with them.

A batch is kept under its stream's id and its number, so one that is run again, after a
restart too, is recognised and not added twice; a stream with a new checkpoint is another
source. A view's first result after a start has all its rows as new. Views are rules over the feed's relations: they are worked out again after a batch
that touches what they read, and subscribers get the rows that came and went.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.analysis import needed
from ..sources.changes import META, ChangeTable
from ..sources.scratch import Scratch


class Feed:
    """A relation of an engine, fed by a stream of changes."""

    def __init__(self, engine, rel: str, path: str):
        self.engine, self.rel, self.table = engine, rel, ChangeTable(engine.spark, path)
        self.views: dict[str, tuple[str, Callable[[DataFrame, DataFrame], None]]] = {}
        self.last: dict[str, DataFrame] = {}
        self.seen: set[tuple[str, int]] = set()
        if self.table.exists():
            self.engine.register(self.rel, self.table.state(), is_set=True)

    def view(self, name: str, query: str, on_change: Callable[[DataFrame, DataFrame], None]) -> None:
        """on_change(rows that came, rows that went) after each batch that may change the query's answers."""
        self.views[name] = (query, on_change)

    def apply(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; _diff is 1 for an insertion, -1 for a retraction (1 if absent)."""
        source = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        if (source, number) in self.seen:
            return
        if "_diff" not in batch.columns:
            batch = batch.withColumn("_diff", F.lit(1).cast("bigint"))
        changes = batch.withColumn("_time", F.lit(number).cast("bigint")).withColumn("_diff", F.col("_diff").cast("bigint"))
        self.table.append_changes(changes, source, number)
        self.seen = {x for x in self.seen if x[0] != source} | {(source, number)}
        self.engine.register(self.rel, self.table.state(), is_set=True)
        from ..plans.parser import parse_query

        for name, (query, on_change) in self.views.items():
            q = parse_query(query)
            reads = {q.goal.rel} | {a.rel for r in needed([q.goal.rel], self.engine.graph.rules) for a in r.atoms}
            if self.rel not in reads:
                continue
            scratch = Scratch(self.engine.spark)
            now = self.engine.query(query)
            now = scratch.read(now.schema, scratch.write(now))
            before = self.last.get(name)
            on_change(now.subtract(before) if before is not None else now, before.subtract(now) if before is not None else now.limit(0))
            self.last[name] = now

    def start(self, stream: DataFrame, checkpoint: str, **options) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return writer.trigger(**(options or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and keys; late rows are awaited for `late`."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide or width), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Counts by session of each key: a session ends after `gap` without an event."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
