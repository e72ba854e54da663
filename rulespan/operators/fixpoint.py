"""Semi-naive evaluation of one component of mutually recursive heads.

Each round evaluates every recursive clause once for each of its recursive atoms, that atom
over the rows new in the last round, the others over all rows, and keeps what is not known
yet. New rows are written to the shared folder, so a plan never holds more than one round,
its inputs have sizes (small ones are broadcast), and a lost executor costs a task.

Heads with one min or max keep the best row of a key instead: a round's new rows are the
keys whose value got better.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RuleError
from ..plans.ast import Agg, Atom, Rule
from ..plans.compiler import compile_rule
from ..plans.relation import Relation, as_kinds, columns, unify, union
from ..sources.scratch import Scratch
from .local_fixpoint import small_fixpoint
from .walk import walk


class Known:
    """Rows of a head so far."""

    def __init__(self, scratch: Scratch, like: Relation):
        self.scratch, self.like, self.schema = scratch, like, like.df.schema
        self.all: list[str] = []
        self.last: str | None = None

    def total(self) -> Relation:
        return replace(self.like, df=self.scratch.read(self.schema, *self.all), is_set=True)

    def delta(self) -> Relation:
        return replace(self.like, df=self.scratch.read(self.schema, self.last), is_set=True)

    def add(self, df: DataFrame) -> bool:
        """Writes new rows; False, and nothing is kept, if there are none."""
        path = self.scratch.write(df)
        if self.scratch.read(self.schema, path).isEmpty():
            self.scratch.delete(path)
            self.last = None
            return False
        self.all.append(path)
        self.last = path
        return True


def extreme(rules: list[Rule]) -> tuple[int, str] | None:
    """(place, min or max) if all clauses of a head aggregate one column by it."""
    found = {(i, a.name) for r in rules for i, a in enumerate(r.head.args) if isinstance(a, Agg)}
    if not found:
        return None
    if len(found) > 1 or any(not r.aggregates for r in rules):
        raise RuleError(f"the clauses of {rules[0].head.rel} in recursion must share one min or max")
    return found.pop()


def fixpoint(spark: SparkSession, part: list[str], rules: list[Rule], outside: Callable[[Atom], Relation | None], facts: Callable[[str], Relation | None], most_rounds: int = 10_000) -> dict[str, Relation]:
    """Relations of the heads in part. outside resolves other relations, facts a head's own stored rows."""
    scratch, members = Scratch(spark), set(part)
    mine = {h: [r for r in rules if r.head.rel == h] for h in part}
    best = {h: extreme([r for r in mine[h]]) for h in part}
    start: dict[str, Relation] = {}
    recursive: list[Rule] = []
    for h in part:
        found = [facts(h)] if facts(h) is not None else []
        for r in mine[h]:
            if any(a.rel in members for a in r.atoms):
                recursive.append(r)
            else:
                found.append(compile_rule(spark, r, outside))
        if found:
            start[h] = union(found, h)
    # Column kinds settle before anything runs.
    for _ in range(len(part) + 2):
        changed = False
        for r in recursive:
            if all(a.rel not in members or a.rel in start for a in r.atoms):
                got = compile_rule(spark, r, lambda a: start[a.rel] if a.rel in members else outside(a))
                if r.head.rel not in start:
                    start[r.head.rel] = replace(got, df=got.df.limit(0))
                    changed = True
                kinds = unify([start[r.head.rel].kinds, got.kinds], r.head.rel)
                non_null = tuple(a and b for a, b in zip(start[r.head.rel].non_null, got.non_null))
                if (kinds, non_null) != (start[r.head.rel].kinds, start[r.head.rel].non_null):
                    start[r.head.rel] = replace(as_kinds(start[r.head.rel], kinds), non_null=non_null)
                    changed = True
        if not changed:
            break
    if not any(best.values()):
        found = small_fixpoint(spark, part, recursive, outside, start, mine[part[0]] if len(part) == 1 else None)
        if found is not None:
            return found
    if len(part) == 1 and part[0] in start:
        one = start[part[0]]
        found = walk(spark, part[0], recursive, outside, replace(one, df=_best(one.df, best[part[0]])) if best[part[0]] else one, best[part[0]])
        if found is not None:
            return {part[0]: found}
    known = {h: Known(scratch, start[h]) for h in start}
    for h in start:
        df = start[h].df
        if best[h]:
            df = _best(df, best[h])
        known[h].add(df)
    for _ in range(most_rounds):
        live = {h for h in known if known[h].last}
        if not live:
            break
        deltas = {h: known[h].delta() for h in live}
        totals = {h: k.total() for h, k in known.items() if k.all}
        found: dict[str, list[Relation]] = {}
        for r in recursive:
            places = [i for i, x in enumerate(r.body) if isinstance(x, Atom) and x.rel in members]
            if any(r.body[i].rel not in totals for i in places):
                continue
            for i in places:
                if r.body[i].rel in live:
                    one = r.body[i]
                    resolve = lambda a, one=one: outside(a) if a.rel not in members else deltas[a.rel] if a is one else totals[a.rel]
                    found.setdefault(r.head.rel, []).append(compile_rule(spark, r, resolve))
        for h in part:
            if h not in known:
                continue
            if h not in found:
                known[h].last = None
                continue
            new = union([as_kinds(x, known[h].like.kinds) for x in found[h]], h).df
            if best[h]:
                _improve(known[h], new, best[h])
            else:
                known[h].add(new.subtract(totals[h].df) if h in totals else new)
    else:
        raise RuleError(f"recursion through {', '.join(part)} did not end in {most_rounds} rounds")
    return {h: (k.total() if k.all else replace(k.like, df=k.like.df.limit(0), is_set=True)) for h, k in known.items()}


def _best(df: DataFrame, how: tuple[int, str]) -> DataFrame:
    place, name = how
    keys = [c for i, c in enumerate(df.columns) if i != place]
    value = (F.min if name == "min" else F.max)(f"c{place}").alias(f"c{place}")
    out = df.groupBy(*keys).agg(value) if keys else df.agg(value).where(F.col(f"c{place}").isNotNull())
    return out.select(*columns(len(df.columns)))


def _improve(known: Known, new: DataFrame, how: tuple[int, str]) -> None:
    """Better rows replace those of their keys."""
    place, name = how
    new = _best(new, how)
    if not known.all:
        known.add(new)
        return
    old = known.total().df
    keys = [c for i, c in enumerate(new.columns) if i != place]
    renamed = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    a, b = F.col(f"c{place}"), F.col(f"o_c{place}")
    better = new.join(renamed, on, "left").where(b.isNull() | (a < b if name == "min" else a > b)).select(*new.columns)
    if not known.add(better):
        return
    changed = known.delta().df.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.lit(1).alias("__hit"))
    kept = old.join(changed, on, "left_anti") if keys else old.limit(0)
    # Older tables stay until the evaluation's folder goes: other heads of this round may read them.
    known.all = [known.scratch.write(kept), known.last]
