"""The engine: statements in, DataFrames out.

    engine = Engine(spark)
    engine.execute('+edge[(1, 2), (2, 3)]\\n+reach(X, Y) <- edge(X, Y)\\n+reach(X, Z) <- reach(X, Y), edge(Y, Z)')
    engine.query('?reach(1, Y)').show()
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Graph, Stored
from .errors import RuleError
from .evaluation import Evaluation
from .functions import register_function  # noqa: F401
from .plans.analysis import check_clauses, check_rule, stratify
from .plans.ast import AddRule, Atom, ConditionalDelete, Delete, DropName, Insert, Query, Rule, Schema, Statement, TypeAlias, Update
from .plans.compiler import term
from .plans.parser import parse_query, parse_statement, split_statements
from .plans.relation import Relation, union
from .sources.scratch import Scratch


@dataclass(frozen=True)
class Change:
    """What subscribers hear: seq grows by one each time."""

    seq: int
    kind: str  # rows, rule, schema or graph
    graph: str
    name: str
    count: int = 0


class Session:
    """Rows and rules of one user over a shared graph; seen by no one else."""

    def __init__(self, engine: Engine, graph: str):
        self.engine, self.graph_name = engine, graph
        self.own = Graph(engine.spark, f"session over {graph}")
        self.rules: list[Rule] = []

    @property
    def graph(self) -> Graph:
        return self.engine.graphs[self.graph_name]

    # --- reading

    def facts(self, rel: str) -> Relation | None:
        parts = [x for x in (self.graph.relation(rel), self.own.relation(rel)) if x is not None]
        return union(parts, rel) if len(parts) > 1 else parts[0] if parts else None

    def evaluation(self, baseline: bool = False) -> Evaluation:
        """baseline: without what this session added."""
        if baseline:
            return Evaluation(self.engine.spark, list(self.graph.rules), self.graph.relation, self.engine.bound_recursion, self.graph.indexes)
        return Evaluation(self.engine.spark, self.graph.rules + [r for r in self.rules if r not in self.graph.rules], self.facts, self.engine.bound_recursion, self.graph.indexes)

    def query(self, text: str | Query) -> DataFrame:
        return self.evaluation().query(parse_query(text) if isinstance(text, str) else text)

    def query_stream(self, text: str | Query) -> Iterator:
        """Answers row by row, a partition at a time on the driver."""
        return self.query(text).toLocalIterator()

    def tagged(self, text: str | Query) -> DataFrame:
        """Answers with `provenance`: persistent where the graph alone gives the row, else ephemeral."""
        q = parse_query(text) if isinstance(text, str) else text
        df, base = self.evaluation().query(q), self.evaluation(baseline=True).query(replace(q, order=(), limit=None, offset=0))
        right = base.toDF(*[f"b{i}" for i in range(len(base.columns))]).withColumn("__there", F.lit(True))
        on = F.lit(True)
        for i, c in enumerate(df.columns):
            on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"b{i}"))
        out = df.join(right, on, "left")
        return out.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("__there"), F.lit("persistent")).otherwise(F.lit("ephemeral")).alias("provenance"))

    # --- writing

    def add_rule(self, rule: Rule) -> None:
        check_rule(rule)
        every = self.graph.rules + self.rules + [rule]
        check_clauses(every)
        stratify(every)
        if rule not in self.rules:
            self.rules.append(rule)

    def clear(self) -> None:
        self.rules, self.own = [], Graph(self.engine.spark, self.own.name)

    # --- statements

    def execute(self, text: str) -> list[object]:
        """Runs every statement; a DataFrame for a query or session rule, a message for others."""
        return [self.run(parse_statement(x)) for x in split_statements(text)]

    def run(self, s: Statement) -> object:
        g = self.graph
        if isinstance(s, Query):
            return self.query(s)
        if isinstance(s, Insert):
            target = self.own if s.session else g
            n = target.insert(s.rel, list(s.rows))
            if not s.session:
                self.engine.notify("rows", g.name, s.rel, n)
            return f"Inserted {n} fact(s) into '{s.rel}'."
        if isinstance(s, Delete):
            g.delete_rows(s.rel, list(s.rows))
            self.engine.notify("rows", g.name, s.rel, -len(s.rows))
            return f"Deleted facts from '{s.rel}'."
        if isinstance(s, ConditionalDelete):
            return self.run(Update((s.target,), (), s.body))
        if isinstance(s, Update):
            self.update(s)
            return f"Updated {', '.join(sorted({a.rel for a in s.deletes + s.inserts}))}."
        if isinstance(s, DropName):
            if not g.drop(s.name):
                raise RuleError(f"no relation or rule {s.name}")
            self.engine.notify("rule", g.name, s.name)
            return f"Dropped '{s.name}'."
        if isinstance(s, AddRule):
            if not s.session:
                g.add_rule(s.rule)
                self.engine.notify("rule", g.name, s.rule.head.rel)
                return f"Rule '{s.rule.head.rel}' registered."
            self.add_rule(s.rule)
            rel = self.evaluation().relation(s.rule.head.rel)
            return rel.named() if len(set(map(str.lower, rel.names))) == rel.width else rel.df
        if isinstance(s, Schema):
            (self.own if s.session else g).declare(s.rel, s.columns)
            self.engine.notify("schema", g.name, s.rel)
            return f"Schema for '{s.rel}' registered with {len(s.columns)} columns."
        if isinstance(s, TypeAlias):
            g.aliases[s.name] = s.type
            return f"Type '{s.name}' registered."
        from .meta import run_meta

        return run_meta(self, s)

    def update(self, s: Update) -> None:
        """All bindings are worked out first; then rows go, then rows come."""
        g = self.graph
        ev = self.evaluation()
        frame = ev.frame(s.body)

        def rows(a: Atom) -> Relation:
            values = [term(x, frame) for x in a.args]
            df = frame.df.select(*[v.column.alias(f"c{i}") for i, v in enumerate(values)]).distinct()
            return Relation(df, tuple(df.columns), tuple(v.kind for v in values), (False,) * len(values), True)

        for a in s.inserts:
            if a.rel in g.heads():
                raise RuleError(f"{a.rel} is derived by rules; rows cannot be inserted")
        after: dict[str, Relation] = {}
        for a in s.deletes:
            have = after.get(a.rel) or g.relation(a.rel)
            if have is None:
                continue
            gone = rows(a)
            right = gone.df.toDF(*[f"g{i}" for i in range(gone.width)])
            on = F.lit(True)
            for i in range(gone.width):
                on = on & F.col(f"c{i}").eqNullSafe(F.col(f"g{i}"))
            after[a.rel] = replace(have, df=have.df.join(right, on, "left_anti"))
        for a in s.inserts:
            have = after.get(a.rel) or g.relation(a.rel)
            after[a.rel] = union([have, rows(a)], a.rel) if have is not None else rows(a)
        scratch, written = Scratch(self.engine.spark), {}
        for rel, r in after.items():  # every result is written before any relation changes
            path = scratch.write(r.df)
            written[rel] = replace(r, df=scratch.read(r.df.schema, path))
        for rel, r in written.items():
            g.stored[rel] = Stored(replace(r, is_set=True))
            g.versions[rel] += 1
            self.engine.notify("rows", g.name, rel)


class Engine(Session):
    """Graphs, the default session, and change notifications."""

    def __init__(self, spark: SparkSession, bound_recursion: bool = True):
        self.spark, self.bound_recursion = spark, bound_recursion
        self.graphs: dict[str, Graph] = {"default": Graph(spark, "default")}
        self.listeners: list[Callable[[Change], None]] = []
        self.seq, self.recent, self.lock = 0, deque(maxlen=1000), threading.Lock()
        self.started = time.time()
        super().__init__(self, "default")

    def session(self, graph: str | None = None) -> Session:
        return Session(self, graph or self.graph_name)

    def register(self, rel: str, df: DataFrame, non_null: bool = False, is_set: bool = False, names: bool = False) -> None:
        self.graph.register(rel, df, non_null, is_set, names)
        self.notify("rows", self.graph_name, rel)

    def subscribe(self, listener: Callable[[Change], None], since: int | None = None) -> None:
        """Calls listener on every change; since replays kept changes after that number."""
        with self.lock:
            kept = [c for c in self.recent if since is not None and c.seq > since]
            self.listeners.append(listener)
        for c in kept:
            listener(c)

    def notify(self, kind: str, graph: str, name: str, count: int = 0) -> None:
        with self.lock:
            self.seq += 1
            change = Change(self.seq, kind, graph, name, count)
            self.recent.append(change)
            to = list(self.listeners)
        for f in to:
            f(change)
