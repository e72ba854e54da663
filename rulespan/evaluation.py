"""Goals to relations: strata in order, recursion by fixpoint, everything else lazily."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import RuleError
from .operators.fixpoint import fixpoint
from .plans.analysis import bound_variables, check_clauses, is_recursive, needed, stratify
from .plans.ast import Atom, Compare, Literal, Query, Rule, Var, variables
from .plans.compiler import NEAREST, BodyCompiler, compile_rule, term
from .plans.relation import Relation, union
from .plans.rewrite import bind, with_variables

Facts = Callable[[str], Relation | None]


class Evaluation:
    """One consistent reading of stored rows and rules; derived relations are worked out once."""

    def __init__(self, spark: SparkSession, rules: list[Rule], facts: Facts, bound_recursion: bool = True, indexes=None):
        self.spark, self.rules, self.facts, self.bound_recursion, self.indexes = spark, rules, facts, bound_recursion, indexes or {}
        self.heads = {r.head.rel for r in rules}
        self.done: dict[str, Relation | None] = {}
        self.extra: dict[str, Relation] = {}
        check_clauses(rules)
        self.part = {h: part for part in stratify(rules) for h in part}

    def resolve(self, a: Atom) -> Relation | None:
        if a.rel == NEAREST:
            return self.indexed(a.args[0])
        return self.relation(a.rel)

    def indexed(self, name) -> Relation:
        """(id, vector) of an index; names[2] is its metric. The id is the first other column."""
        index = self.indexes.get(getattr(name, "value", None))
        if index is None:
            raise RuleError(f"no index {name}")
        rel = self.relation(index.relation)
        if rel is None or index.column not in rel.names:
            raise RuleError(f"index {name}: {index.relation} has no column {index.column}")
        at = rel.names.index(index.column)
        key = next((i for i in range(rel.width) if i != at), at)
        df = rel.df.select(F.col(f"c{key}").alias("c0"), F.col(f"c{at}").alias("c1"))
        return Relation(df, (rel.names[key], rel.names[at], index.metric), (rel.kinds[key], "vec"), (False, False), rel.is_set)

    def stored(self, rel: str) -> Relation | None:
        return self.extra.get(rel) or self.facts(rel)

    def relation(self, rel: str) -> Relation | None:
        """Stored and derived rows, or None for an unknown name."""
        if rel in self.done:
            return self.done[rel]
        if rel not in self.heads:
            found = self.stored(rel)
            self.done[rel] = found.distinct() if found is not None else None
            return self.done[rel]
        part = self.part[rel]
        rules = [r for r in self.rules if r.head.rel in part]
        if is_recursive(part, rules):
            self.done |= fixpoint(self.spark, part, rules, self.resolve, self.stored)
            for h in part:
                self.done.setdefault(h, None)
        else:
            parts = [compile_rule(self.spark, r, self.resolve) for r in rules]
            own = self.stored(rel)
            self.done[rel] = union(parts + ([own] if own is not None else []), rel)
            schema = own.names if own is not None and own.declared else None
            if schema:
                self.done[rel] = replace(self.done[rel], names=schema, declared=True)
        return self.done[rel]

    def _bound(self, goal: Atom, body: tuple[Literal, ...]) -> Atom:
        """The goal, over a head restricted by its constants where that helps and holds."""
        if not self.bound_recursion or goal.rel not in self.heads or self.part[goal.rel] != [goal.rel]:
            return goal
        rules = [r for r in self.rules if r.head.rel == goal.rel]
        if not is_recursive([goal.rel], rules):
            return goal
        stored = self.stored(goal.rel)
        found = bind(goal, rules, stored is not None)
        if not found:
            return goal
        bound, more = found
        # Types of constants must fit: a constant of another kind would widen the base rows.
        sub = Evaluation(self.spark, [r for r in needed([goal.rel], self.rules) if r.head.rel != goal.rel] + more, self.facts, False, self.indexes)
        sub.done |= {k: v for k, v in self.done.items() if k not in (goal.rel,)}
        if stored is not None:
            sub.extra[f"{goal.rel}__stored"] = stored
        self.extra[bound.rel] = sub.relation(bound.rel)
        return bound

    def frame(self, body: tuple[Literal, ...], keep_wild: bool = False):
        return BodyCompiler(self.spark, self.resolve, keep_wild).compile(body)

    def query(self, q: Query) -> DataFrame:
        goal, shown = with_variables(q.goal)
        body = q.body
        for x in q.goal.args:
            if not hasattr(x, "value") and not isinstance(x, Var) and x.__class__.__name__ != "Wild":
                raise RuleError(f"{x} in a goal: compare a variable with it instead")
        for x in body:
            if not set(variables(x)) <= bound_variables((goal, *body)):
                free = next(v for v in variables(x) if v not in bound_variables((goal, *body)))
                raise RuleError(f"variable {free} in {x} is not bound")
        known = {t.name for _, t in shown if isinstance(t, Var)}
        for x in body:
            if isinstance(x, Atom) and x.negated:
                continue
            for v in variables(x):
                if v not in known:
                    known.add(v)
                    shown.append((v, Var(v)))
        # Constants compared with goal variables bind recursion as well.
        constants = {c.left.name: c.right for c in body if isinstance(c, Compare) and c.op == "=" and isinstance(c.left, Var) and hasattr(c.right, "value")}
        probe = replace(goal, args=tuple(constants.get(a.name, a) if isinstance(a, Var) else a for a in goal.args))
        bound = self._bound(probe, body) if goal.rel not in self.done else probe
        if bound.rel != goal.rel:
            goal = replace(goal, rel=bound.rel)
        rel = self.relation(goal.rel) if goal.rel != NEAREST else None
        frame = self.frame((goal, *body))
        names, out, used = [], [], set()
        for i, (name, t) in enumerate(shown):
            if rel is not None and rel.declared and i < len(goal.args) and not body:
                name = rel.names[i]
            while name.lower() in used:
                name += "_"
            used.add(name.lower())
            names.append(name)
            out.append(term(t, frame).column.alias(name))
        df = frame.df.select(*out)
        plain = {t.name for _, t in shown if isinstance(t, Var)}
        if not (frame.exact and frame.from_atoms <= plain):
            df = df.distinct()
        if q.order:
            df = df.orderBy(*[F.col(f"`{names[i]}`").desc_nulls_last() if down else F.col(f"`{names[i]}`").asc_nulls_first() for i, down in q.order])
        elif q.limit is not None:
            df = df.orderBy(*[F.col(f"`{n}`").asc_nulls_first() for n in names])
        if q.offset:
            df = df.offset(q.offset)
        return df.limit(q.limit) if q.limit is not None else df
