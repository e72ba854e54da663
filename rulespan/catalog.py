"""Knowledge graphs: stored relations, rules, schemas, index declarations, versions."""

from __future__ import annotations

import fnmatch
from collections import defaultdict
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import RuleError
from .functions.registry import Typed
from .plans.analysis import check_clauses, check_rule, stratify, width
from .plans.ast import Rule
from .plans.compiler import equal
from .plans.relation import Relation, as_kinds, empty, from_frame, unify
from .sources.scratch import Scratch

#: Names of declared types and their kinds; any is unchecked.
TYPES = {"int": "long", "integer": "long", "long": "long", "int64": "long", "timestamp": "long", "float": "double", "double": "double", "float64": "double", "string": "string", "str": "string", "text": "string", "symbol": "string", "bool": "boolean", "boolean": "boolean", "vector": "vec", "any": "any"}
ROWS_IN_MEMORY = 10_000  # inserted rows a relation keeps on the driver before they go to a table


def kind_of_value(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "long"
    if isinstance(v, float):
        return "double"
    if isinstance(v, str):
        return "string"
    if isinstance(v, tuple | list):
        return "vec"
    raise RuleError(f"no kind for {v!r}")


@dataclass
class Schema:
    names: tuple[str, ...]
    kinds: tuple[str, ...]
    dims: tuple[int | None, ...]


@dataclass
class Stored:
    """Rows of a relation: a table part and rows inserted by statements."""

    table: Relation | None = None
    rows: set[tuple] = field(default_factory=set)
    kinds: tuple[str, ...] | None = None
    edits: int = 0


@dataclass
class Index:
    name: str
    relation: str
    column: str
    metric: str = "cosine"
    options: dict[str, str] = field(default_factory=dict)


class Graph:
    """One knowledge graph."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.stored: dict[str, Stored] = {}
        self.rules: list[Rule] = []
        self.schemas: dict[str, Schema] = {}
        self.aliases: dict[str, str] = {}
        self.indexes: dict[str, Index] = {}
        self.versions: dict[str, int] = defaultdict(int)

    # --- schemas

    def declare(self, rel: str, declared: tuple[tuple[str, str], ...]) -> None:
        names, kinds, dims = [], [], []
        for name, text in declared:
            text = self.aliases.get(text, text)
            base = text.split("(")[0].split("[")[0].lower()
            if base not in TYPES and not text.startswith(("list", "{")):
                raise RuleError(f"no type {text}")
            names.append(name)
            kinds.append(TYPES.get(base, "any"))
            inner = text[text.find("[") + 1 : -1] if base == "vector" and "[" in text else ""
            dims.append(int(inner) if inner.isdigit() else None)
        schema = Schema(tuple(names), tuple(kinds), tuple(dims))
        old = self.stored.get(rel)
        if old:
            for row in old.rows:
                self._check(rel, schema, row)
            if old.table is not None:
                ok = tuple(k for k in old.table.kinds)
                if len(ok) != len(kinds) or any(k not in (a, "any") and not (k == "double" and a == "long") for a, k in zip(ok, kinds)):
                    raise RuleError(f"stored rows of {rel} do not fit the schema")
        self.schemas[rel] = schema
        self.versions[rel] += 1

    @staticmethod
    def _check(rel: str, schema: Schema, row: tuple) -> None:
        if len(row) != len(schema.kinds):
            raise RuleError(f"{rel} has {len(schema.kinds)} columns, not {len(row)}")
        for v, kind, dim, name in zip(row, schema.kinds, schema.dims, schema.names):
            got = kind_of_value(v)
            if kind != "any" and got not in (kind, "null") and not (kind == "double" and got == "long"):
                raise RuleError(f"{rel}.{name} is {kind}, not {got}")
            if dim is not None and isinstance(v, tuple | list) and len(v) != dim:
                raise RuleError(f"{rel}.{name} has {dim} dimensions, not {len(v)}")

    # --- rows

    def heads(self) -> set[str]:
        return {r.head.rel for r in self.rules}

    def register(self, rel: str, df: DataFrame, non_null: bool = False, is_set: bool = False, names: bool = False) -> None:
        """A DataFrame as a stored relation; see from_frame for the promises. names makes its column names show in answers."""
        r = from_frame(df, non_null, is_set).distinct()
        self.stored[rel] = Stored(replace(r, declared=names))
        self.versions[rel] += 1

    def insert(self, rel: str, rows: list[tuple]) -> int:
        """Rows that were not there."""
        if rel.startswith("__"):
            raise RuleError(f"names that begin with __ are reserved: {rel}")
        if rel in self.heads():
            raise RuleError(f"{rel} is derived by rules; rows cannot be inserted")
        rows = [tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in rows]
        if len({len(r) for r in rows}) > 1:
            raise RuleError(f"rows for {rel} differ in arity")
        s = self.stored.get(rel) or Stored()
        if rel in self.schemas:
            for r in rows:
                self._check(rel, self.schemas[rel], r)
        found = [tuple(map(kind_of_value, r)) for r in rows]
        have = [s.kinds] if s.kinds else []
        have += [s.table.kinds] if s.table is not None else []
        if have and rows and len(have[0]) != len(rows[0]):
            raise RuleError(f"{rel} has {len(have[0])} columns, not {len(rows[0])}")
        kinds = unify(have + list(dict.fromkeys(found)), rel) if rows else None
        new = [r for r in dict.fromkeys(rows) if r not in s.rows]
        if s.table is not None and new:
            mine = self._local(new, kinds).df.withColumn("__n", F.lit(0))
            mine = self.spark.createDataFrame([(*x[:-1], i) for i, x in enumerate(mine.collect())], mine.schema)
            table = as_kinds(s.table, kinds).df.toDF(*[f"t{i}" for i in range(len(kinds))])
            on = F.lit(True)
            for i in range(len(kinds)):
                on = on & F.col(f"c{i}").eqNullSafe(F.col(f"t{i}"))
            there = {x[0] for x in mine.join(table, on, "left_semi").select("__n").collect()}  # no more than were inserted
            new = [r for i, r in enumerate(new) if i not in there]
        s.rows |= set(new)
        s.kinds = kinds or s.kinds
        self.stored[rel] = s
        if len(s.rows) > ROWS_IN_MEMORY:
            self._compact(rel)
        self.versions[rel] += 1
        return len(new)

    def _local(self, rows: list[tuple], kinds: tuple[str, ...]) -> Relation:
        """Few rows as a relation."""
        types = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "vec": T.ArrayType(T.FloatType()), "null": T.NullType()}
        data = [tuple(float(v) if k == "double" and v is not None else list(v) if k == "vec" and v is not None else v for v, k in zip(r, kinds)) for r in rows]
        schema = T.StructType([T.StructField(f"c{i}", types[k]) for i, k in enumerate(kinds)])
        df = self.spark.createDataFrame(data, schema)
        return Relation(df, tuple(f"col{i}" for i in range(len(kinds))), tuple(kinds), tuple(all(r[i] is not None for r in rows) for i in range(len(kinds))), True)

    def relation(self, rel: str) -> Relation | None:
        """Stored rows, or None if nothing is stored or declared."""
        s = self.stored.get(rel)
        schema = self.schemas.get(rel)
        out: Relation | None = None
        if s:
            parts = [s.table] if s.table is not None else []
            if s.rows:
                parts.append(self._local(sorted(s.rows, key=repr), s.kinds))
            if len(parts) == 2:  # inserted rows are known not to be in the table
                kinds = unify([p.kinds for p in parts], rel)
                a, b = (as_kinds(p, kinds) for p in parts)
                out = replace(a, df=a.df.union(b.df), non_null=tuple(x and y for x, y in zip(a.non_null, b.non_null)), is_set=True)
            elif parts:
                out = parts[0]
            elif s.kinds:
                out = empty(self.spark, len(s.kinds), s.kinds)
        if schema:
            kinds = tuple("null" if k == "any" else k for k in schema.kinds)
            out = as_kinds(out, unify([out.kinds, kinds], rel)) if out is not None else empty(self.spark, len(kinds), kinds)
            out = replace(out, names=schema.names, declared=True)
        return out

    def _compact(self, rel: str) -> None:
        r = self.relation(rel)
        scratch = Scratch(self.spark)
        path = scratch.write(r.df)
        self.stored[rel] = Stored(replace(r, df=scratch.read(r.df.schema, path)))

    def replace_rows(self, rel: str, r: Relation) -> None:
        """A relation's rows become those of r, which is written so that later edits do not stack up plans."""
        scratch = Scratch(self.spark)
        path = scratch.write(r.df)
        self.stored[rel] = Stored(replace(r, df=scratch.read(r.df.schema, path), is_set=True))
        self.versions[rel] += 1

    def delete(self, rel: str, gone: Relation) -> None:
        """Removes the rows of gone, nulls equal; same width."""
        have = self.relation(rel)
        if have is None:
            return
        if have.width != gone.width:
            raise RuleError(f"{rel} has {have.width} columns, not {gone.width}")
        right = gone.df.toDF(*[f"g{i}" for i in range(gone.width)])
        on = F.lit(True)
        for i in range(gone.width):
            on = on & equal(Typed(F.col(f"c{i}"), have.kinds[i]), Typed(F.col(f"g{i}"), gone.kinds[i]))
        self.replace_rows(rel, replace(have, df=have.df.join(right, on, "left_anti")))

    def delete_rows(self, rel: str, rows: list[tuple]) -> None:
        s = self.stored.get(rel)
        rows = [tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in rows]
        if not s or not rows:
            return
        if s.table is None:
            s.rows -= set(rows)
            self.versions[rel] += 1
            return
        kinds = unify([tuple(map(kind_of_value, r)) for r in rows], rel)
        self.delete(rel, self._local(rows, kinds))

    # --- rules

    def add_rule(self, rule: Rule) -> None:
        check_rule(rule)
        if rule in self.rules:
            return
        rules = self.rules + [rule]
        check_clauses(rules)
        stratify(rules)
        stored = self.relation(rule.head.rel)
        if stored is not None and stored.width != width(rule):
            raise RuleError(f"{rule.head.rel} has {stored.width} columns, not {width(rule)}")
        self.rules = rules
        self.versions[rule.head.rel] += 1

    def drop(self, name: str) -> bool:
        """A relation's rows, schema and rules."""
        had = name in self.stored or name in self.schemas or name in self.heads()
        self.stored.pop(name, None)
        self.schemas.pop(name, None)
        self.rules = [r for r in self.rules if r.head.rel != name]
        self.versions[name] += 1
        return had

    def matching(self, prefix: str) -> list[str]:
        return sorted(x for x in set(self.stored) | set(self.schemas) if fnmatch.fnmatchcase(x, prefix + "*"))
