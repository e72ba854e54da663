"""A rule or query body to one lazy DataFrame; Catalyst picks the physical plan.

Atoms join in an order that follows shared variables, so cross products arise only where the
rule has one. Assignments bind as soon as they can, which turns `b(P), P = X - 1` into an
equi-join. Atoms that bind nothing new become semi-joins. A distinct is added only where
rows are not known to be distinct already.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import RuleError
from ..functions.mathematics import arithmetic, number
from ..functions.registry import Typed, call
from ..operators import aggregates, knn, pairs
from ..operators.running import running
from .ast import RANKING, Agg, Arith, Atom, Call, Compare, Const, Literal, Rule, Term, Var, Wild, variables
from .relation import Relation, as_kinds, empty

Resolve = Callable[[Atom], Relation | None]
TOLERANCE = 1e-10
NEAREST = "hnsw_nearest"
#: Rows of a table that goes whole to every task of an all-pairs join, and pairs a task.
WHOLE, PAIRS = 1_000_000, 100_000_000


@dataclass
class Frame:
    """Bindings: a column a variable, and what is known about them."""

    df: DataFrame | None = None
    columns: dict[str, str] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    non_null: set[str] = field(default_factory=set)
    exact: bool = True  # rows are distinct over the variables that atoms bind
    from_atoms: set[str] = field(default_factory=set)
    fresh: int = 0

    def new(self) -> str:
        self.fresh += 1
        return f"v{self.fresh}"

    def typed(self, name: str) -> Typed:
        return Typed(F.col(self.columns[name]), self.kinds[name])


def constant(value: object) -> Typed:
    if isinstance(value, bool):
        return Typed(F.lit(value), "boolean")
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise RuleError(f"{value} does not fit 64 bits")
        return Typed(F.lit(value).cast("bigint"), "long")
    if isinstance(value, float):
        return Typed(F.lit(value), "double")
    if isinstance(value, str):
        return Typed(F.lit(value), "string")
    if value is None:
        return Typed(F.lit(None), "null")
    if isinstance(value, tuple | list):
        return Typed(F.array(*[F.lit(float(x)) for x in value]).cast("array<float>"), "vec")
    raise RuleError(f"no value of this kind: {value!r}")


def term(x: Term, frame: Frame) -> Typed:
    if isinstance(x, Const):
        return constant(x.value)
    if isinstance(x, Var):
        if x.name not in frame.columns:
            raise RuleError(f"variable {x.name} is not bound")
        return frame.typed(x.name)
    if isinstance(x, Arith):
        return arithmetic(x.op, term(x.left, frame), term(x.right, frame))
    if isinstance(x, Call):
        return call(x.name, [term(a, frame) for a in x.args])
    raise RuleError(f"{x} is no value")


def comparable(a: Typed, b: Typed) -> tuple[Column, Column] | None:
    """Both columns in one type, or None if the kinds never compare."""
    if a.kind == b.kind or "null" in (a.kind, b.kind):
        return a.column, b.column
    if a.numeric and b.numeric:
        return a.column.cast("double"), b.column.cast("double")
    return None


def equal(a: Typed, b: Typed, non_null: bool = False) -> Column:
    """Null equals null."""
    both = comparable(a, b)
    if both is None:
        return F.lit(False)
    return both[0] == both[1] if non_null else both[0].eqNullSafe(both[1])


def comparison(c: Compare, frame: Frame) -> Column:
    left, right, op = c.left, c.right, c.op
    if isinstance(left, Const) and not isinstance(right, Const):
        left, right, op = right, left, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
    a, b = term(left, frame), term(right, frame)
    both = comparable(a, b)
    known = isinstance(right, Const)
    if op in ("=", "!="):
        if both is None:
            return F.lit(op == "!=")
        if known and "double" in (a.kind, b.kind):
            near = F.abs(both[0] - both[1]) < TOLERANCE
            return near if op == "=" else both[0].isNull() | ~near
        if known:
            return both[0] == both[1] if op == "=" else both[0].isNull() | (both[0] != both[1])
        same = both[0].eqNullSafe(both[1])
        return same if op == "=" else ~same
    if both is None:
        return F.lit(False)
    return {"<": both[0] < both[1], ">": both[0] > both[1], "<=": both[0] <= both[1], ">=": both[0] >= both[1]}[op]


class BodyCompiler:
    def __init__(self, spark: SparkSession, resolve: Resolve, keep_wild: bool, rule: Rule | None = None):
        self.spark, self.resolve, self.keep_wild, self.rule = spark, resolve, keep_wild, rule
        self.sizes: list[int] = []  # rows of the first and second atom, where they are paired without a shared variable

    def nearest(self, a: Atom, frame: Frame) -> Frame:
        """hnsw_nearest(index, vector, k, Id, Distance[, ef]): exact, for a constant vector or each bound one."""
        if not 5 <= len(a.args) <= 6 or not isinstance(a.args[2], Const):
            raise RuleError(f"use {NEAREST}(index, vector, k, Id, Distance)")
        rel, query, k = self.resolve(a), a.args[1], int(a.args[2].value)
        metric, kinds = rel.names[2], (rel.kinds[0], "double")
        if isinstance(query, Const):
            df = knn.nearest(rel.df, "c0", "c1", list(query.value), k, metric=metric).toDF("c0", "c1")
            return self.atom(Atom(a.rel, a.args[3:5]), frame, Relation(df, rel.names[:2], kinds, (False, False), True))
        found = self.nearest_of_rows(a, frame, rel)
        if found is not None:
            return found
        each = frame.df.select(F.col(frame.columns[query.name]).alias("q")).distinct()
        far = rel.df.crossJoin(each).select("q", "c0", knn.distance(metric, F.col("q"), F.col("c1")).alias("d"))
        best = far.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "c0"))).where(F.col("n") <= k).select(F.col("q").alias("c0"), F.col("c0").alias("c1"), F.col("d").alias("c2"))
        return self.atom(Atom(a.rel, (query, *a.args[3:5])), frame, Relation(best, ("q", "id", "d"), ("vec", *kinds), (False,) * 3, True))

    def nearest_of_rows(self, a: Atom, frame: Frame, rel: Relation) -> Frame | None:
        """hnsw_nearest where other bound variables tell the rows apart: they stand for the vector in the answer."""
        others = [v for v in frame.columns if v != a.args[1].name]
        if not others or rel.kinds[0] != "long" or frame.kinds[a.args[1].name] != "vec":
            return None
        names = [frame.columns[v] for v in others]
        best = knn.tiled(frame.df, names, frame.columns[a.args[1].name], rel.df, "c0", "c1", int(a.args[2].value), rel.names[2])
        if best is None:
            return None
        n = len(others)
        out = best.select(*[F.col(f"l{i}").alias(f"c{i}") for i in range(n)], F.col("r0").alias(f"c{n}"), F.col("d0").alias(f"c{n + 1}"))
        kinds = (*[frame.kinds[v] for v in others], rel.kinds[0], "double")
        non_null = (*[v in frame.non_null for v in others], False, False)
        return self.atom(Atom(a.rel, (*[Var(v) for v in others], *a.args[3:5])), frame, Relation(out, (*others, "id", "d"), kinds, non_null, True))

    def paired(self, body: tuple[Literal, ...]) -> tuple[Frame, list[Compare]] | None:
        """A rule's two atoms with distances between a vector of the one and a vector of the other, in tiles; and what is left to settle."""
        atoms = [x for x in body if isinstance(x, Atom)]
        calls = [c for c in body if isinstance(c, Compare) and c.op == "=" and isinstance(c.left, Var) and isinstance(c.right, Call) and c.right.name in pairs.KERNELS]
        if self.rule is None or len(atoms) != 2 or any(x.negated or x.rel == NEAREST for x in atoms) or not calls:
            return None
        bound = [set(variables(x)) for x in atoms]
        shared = sorted(bound[0] & bound[1])
        vectors: list[str] = []
        for i in (0, 1):
            here = {v.name for c in calls for v in c.right.args if isinstance(v, Var) and v.name in bound[i] and v.name not in shared}
            vectors += sorted(here)
        measured = [c.left.name for c in calls]
        if len(vectors) != 2 or vectors[0] not in bound[0] or vectors[1] not in bound[1] or len(set(measured)) < len(measured) or set(measured) & (bound[0] | bound[1]):
            return None
        if any(len(c.right.args) != 2 or {getattr(v, "name", None) for v in c.right.args} != set(vectors) for c in calls):
            return None
        rest = [c for c in body if isinstance(c, Compare) and c not in calls]
        mine: list[list[Compare]] = [[], []]
        again = True
        while again:
            again = False
            for c in list(rest):
                for i in (0, 1):
                    free = [a.name for a, b in ((c.left, c.right), (c.right, c.left)) if c.op == "=" and isinstance(a, Var) and a.name not in bound[0] | bound[1] and set(variables(b)) <= bound[i]]
                    if set(variables(c)) <= bound[i] or free and free[0] not in measured:
                        bound[i] |= set(free[:1])
                        mine[i].append(c)
                        rest.remove(c)
                        again = True
                        break
        head = {v for x in self.rule.head.args for v in variables(x)}
        if self.rule.aggregates:
            head |= {g.order for g in self.rule.aggregates if g.order}
        need = head | {v for c in rest for v in variables(c)}
        if need & set(vectors):
            return None
        frames = [BodyCompiler(self.spark, self.resolve, False).compile((atoms[i], *mine[i])) for i in (0, 1)]
        kinds = {pairs.KERNELS[c.right.name][0] for c in calls}
        if len(kinds) > 1 or any(frames[i].kinds[vectors[i]] not in kinds for i in (0, 1)) or any(frames[0].kinds[v] != frames[1].kinds[v] for v in shared):
            return None
        k = apart = tie = None
        at = [0, 1]
        if self.rule.aggregates:
            g = self.rule.aggregates[0]
            ids = [v.name for v in g.vars if v.name not in measured]
            if g.name != "top_k" or g.descending or len(calls) > 1 or g.order != measured[0] or len(ids) != 1 or len(rest) > 1 or int(g.params[0]) < 1:
                return None
            keys = {x.name for x in self.rule.head.args if isinstance(x, Var)}
            at = [0, 1] if ids[0] in bound[1] else [1, 0]
            left, right = frames[at[0]], frames[at[1]]
            if ids[0] in shared or right.kinds.get(ids[0]) != "long" or not keys <= set(left.columns):
                return None
            k, tie = int(g.params[0]), ids[0]
            if rest:
                c = rest.pop()
                both = sorted((c.left, c.right), key=lambda x: isinstance(x, Var) and x.name in right.columns)
                if c.op != "!=" or not all(isinstance(x, Var) for x in both) or not (both[0].name in left.columns and both[1].name in right.columns and left.kinds[both[0].name] == right.kinds[both[1].name] == "long"):
                    return None
                if both[0].name in shared or both[1].name in shared or not {both[0].name} <= keys or both[1].name != tie:
                    return None
                apart = (both[0].name, both[1].name)
        sides = []
        for i in at:
            f = frames[i]
            carried = [v for v in f.columns if v in need and v not in shared]
            by = [v for v in f.columns if v in head]
            side = pairs.described(pairs.Side(f.df, tuple(f.columns[v] for v in shared), tuple(f.columns[v] for v in carried), f.columns[vectors[i]]), [f.columns[v] for v in by])
            if side is None or (k and not side.unique):
                return None
            sides.append((side, f, carried, by))
        (left, lf, lc, lby), (right, rf, rc, rby) = sides
        if left.size != right.size or min(left.rows, right.rows) <= pairs.FEW:
            return None
        for f, v in ((lf, apart and apart[0]), (rf, tie)):
            if v and v not in f.non_null and not f.df.where(F.col(f.columns[v]).isNull()).isEmpty():
                return None
        apart = (lf.columns[apart[0]], rf.columns[apart[1]]) if apart else None
        df = pairs.distances(left, right, [c.right.name for c in calls], k, apart, rf.columns[tie] if tie else None)
        out = Frame()
        names = [(f"k{i}", v, lf) for i, v in enumerate(shared)] + [(f"l{i}", v, lf) for i, v in enumerate(lc)] + [(f"r{i}", v, rf) for i, v in enumerate(rc)]
        picked = []
        for name, v, f in names:
            out.columns[v], out.kinds[v] = out.new(), f.kinds[v]
            if v in f.non_null:
                out.non_null.add(v)
            picked.append(F.col(name).alias(out.columns[v]))
        for i, v in enumerate(measured):
            out.columns[v], out.kinds[v] = out.new(), "double"
            picked.append(F.col(f"d{i}").alias(out.columns[v]))
        out.df = df.select(*picked)
        out.exact = left.unique and right.unique
        out.from_atoms = {*lby, *rby}
        return out, rest

    def atom(self, a: Atom, frame: Frame, rel: Relation | None = None) -> Frame:
        """The atom alone: constants and repeated variables filter, wildcards go (or stay, nameless)."""
        if rel is None and a.rel == NEAREST:
            return self.nearest(a, frame)
        rel = rel or self.resolve(a) or empty(self.spark, len(a.args))
        if rel.width != len(a.args):
            raise RuleError(f"{a.rel} has {rel.width} columns, not {len(a.args)}")
        out = Frame(fresh=frame.fresh)
        df, picked, exact = rel.df, [], rel.is_set
        for i, x in enumerate(a.args):
            here = Typed(F.col(f"c{i}"), rel.kinds[i])
            if isinstance(x, Const):
                probe = Frame(columns={"_": f"c{i}"}, kinds={"_": rel.kinds[i]})
                df = df.where(comparison(Compare("=", Var("_"), x), probe))
            elif isinstance(x, Var) and x.name in out.columns:
                before = next(j for j, y in enumerate(a.args) if y == x)
                df = df.where(equal(Typed(F.col(f"c{before}"), rel.kinds[before]), here))
            elif isinstance(x, Var):
                out.columns[x.name], out.kinds[x.name] = out.new(), rel.kinds[i]
                out.from_atoms.add(x.name)
                if rel.non_null[i]:
                    out.non_null.add(x.name)
                picked.append(F.col(f"c{i}").alias(out.columns[x.name]))
            elif isinstance(x, Wild):
                if self.keep_wild:
                    picked.append(F.col(f"c{i}").alias(out.new()))
                else:
                    exact = False
            else:
                raise RuleError(f"{a}: assign {x} to a variable first")
        out.df = df.select(*picked) if picked else df.select(F.lit(1).alias(out.new()))
        out.exact = exact
        return out

    def join(self, frame: Frame, other: Frame, semi: bool) -> Frame:
        shared = [v for v in other.columns if v in frame.columns]
        on = None
        for v in shared:
            pair = equal(frame.typed(v), other.typed(v), v in frame.non_null and v in other.non_null)
            on = pair if on is None else on & pair
        how = "left_semi" if semi else "inner"
        frame.fresh = other.fresh
        if on is None:
            frame.df = self.spread(frame.df, other.df)
        else:
            frame.df = frame.df.join(other.df, on, how)
        if not semi:
            frame.df = frame.df.drop(*[other.columns[v] for v in shared]) if shared else frame.df
            frame.exact = frame.exact and other.exact
            for v, c in other.columns.items():
                if v not in frame.columns:
                    frame.columns[v], frame.kinds[v] = c, other.kinds[v]
                    if v in other.non_null:
                        frame.non_null.add(v)
            frame.from_atoms |= other.from_atoms
        frame.non_null |= {v for v in shared if v in other.non_null}
        return frame

    def spread(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """All pairs; of two stored tables the larger is dealt out by the number of pairs, however few files it has, and meets the smaller whole."""
        if not self.sizes or min(self.sizes) > WHOLE or self.sizes[0] * self.sizes[1] <= PAIRS:
            return left.crossJoin(right)
        parts = min(4000, -(-self.sizes[0] * self.sizes[1] // PAIRS))
        if self.sizes[0] < self.sizes[1]:
            return F.broadcast(left).crossJoin(right.repartition(parts))
        return left.repartition(parts).crossJoin(F.broadcast(right))

    def settle(self, frame: Frame, todo: list[Compare]) -> None:
        """Runs every assignment and filter whose variables are bound."""
        again = True
        while again:
            again = False
            for c in list(todo):
                if c.op == "=":
                    target = None
                    for a, b in ((c.left, c.right), (c.right, c.left)):
                        if isinstance(a, Var) and a.name not in frame.columns and set(variables(b)) <= set(frame.columns):
                            target = (a.name, term(b, frame), b)
                            break
                    if target:
                        name, value, source = target
                        frame.columns[name], frame.kinds[name] = frame.new(), value.kind
                        frame.df = frame.df.withColumn(frame.columns[name], value.column)
                        if isinstance(source, Const) or isinstance(source, Var) and source.name in frame.non_null:
                            frame.non_null.add(name)
                        todo.remove(c)
                        again = True
                        continue
                if set(variables(c)) <= set(frame.columns):
                    frame.df = frame.df.where(comparison(c, frame))
                    todo.remove(c)
                    again = True

    @staticmethod
    def ready(a: Atom, frame: Frame) -> bool:
        return a.rel != NEAREST or len(a.args) < 2 or isinstance(a.args[1], Const) or getattr(a.args[1], "name", None) in frame.columns

    def compile(self, body: tuple[Literal, ...]) -> Frame:
        positive = [x for x in body if isinstance(x, Atom) and not x.negated]
        negative = [x for x in body if isinstance(x, Atom) and x.negated]
        todo = [x for x in body if isinstance(x, Compare)]
        frame = Frame()
        if found := self.paired(body):
            frame, todo = found
            positive = []
        elif not positive:
            frame.df = self.spark.range(1).select(F.lit(1).alias(frame.new()))
        while positive:
            at = 0
            if frame.columns:
                if frame.df is not None:
                    self.settle(frame, todo)
                at = next((i for i, a in enumerate(positive) if set(variables(a)) & set(frame.columns) and self.ready(a, frame)), -1)
            if at < 0 or not frame.columns:
                at = next((i for i, a in enumerate(positive) if self.ready(a, frame)), -1)
            if at < 0:
                raise RuleError(f"{positive[0]}: nothing binds its vector")
            a = positive.pop(at)
            other = self.atom(a, frame)
            if frame.df is None:
                frame = other
            else:
                new = [v for v in other.columns if v not in frame.columns]
                wild = any(isinstance(x, Wild) for x in a.args)
                semi = not new and bool(other.columns) and not (wild and self.keep_wild)
                frame = self.join(frame, other, semi)
        self.settle(frame, todo)
        if todo:
            raise RuleError(f"{todo[0]} uses variables that nothing binds")
        for a in negative:
            frame = self.without(frame, a)
        return frame

    def without(self, frame: Frame, a: Atom) -> Frame:
        other = BodyCompiler(self.spark, self.resolve, False).atom(Atom(a.rel, a.args), frame)
        shared = [v for v in other.columns if v in frame.columns]
        if len(shared) < len(other.columns):
            raise RuleError(f"{a} needs shared variables only")
        on = None if shared else F.lit(True)  # without variables: nothing may match at all
        for v in shared:
            pair = equal(frame.typed(v), other.typed(v), v in frame.non_null and v in other.non_null)
            on = pair if on is None else on & pair
        frame.fresh = other.fresh
        frame.df = frame.df.join(other.df, on, "left_anti")
        return frame


def up_to(spark: SparkSession, rule: Rule, resolve: Resolve) -> Relation | None:
    """h(K, .., sum<B>) <- l(K, ..), r(J, B, ..), J <= K and the like as running totals; None where the rule is something else."""
    aggs, atoms = rule.aggregates, [x for x in rule.body if isinstance(x, Atom)]
    if len(aggs) != 1 or aggs[0].name not in ("sum", "count") or len(atoms) != 2 or any(x.negated or x.rel == NEAREST for x in atoms):
        return None
    bound = [set(variables(x)) for x in atoms]
    shared, rest = sorted(bound[0] & bound[1]), [x for x in rule.body if isinstance(x, Compare)]
    across = [c for c in rest if not any(set(variables(c)) <= b for b in bound)]
    if len(across) != 1 or across[0].op not in ("<", "<=", ">", ">=") or not (isinstance(across[0].left, Var) and isinstance(across[0].right, Var)):
        return None
    c, keys, value = across[0], [x.name for x in rule.head.args if isinstance(x, Var)], aggs[0].vars[0].name
    at = 0 if set(keys) <= bound[0] else 1
    here = c.left.name if c.left.name in bound[at] else c.right.name
    there, op = (c.right.name, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[c.op]) if here == c.left.name else (c.left.name, c.op)
    if not set(keys) <= bound[at] or not {here, *shared} <= set(keys) or here in shared or there in shared or there not in bound[1 - at] or value not in bound[1 - at] or value in shared:
        return None
    frames = []
    for i in (at, 1 - at):
        own = [x for x in rest if x is not c and set(variables(x)) <= bound[i]]
        f = BodyCompiler(spark, resolve, True).compile((atoms[i], *own))
        f.df = f.df if f.exact else f.df.distinct()
        frames.append(f)
    left, right = frames
    v = right.typed(value)
    if left.kinds[here] != "long" or right.kinds[there] != "long" or any(left.kinds[k] != right.kinds[k] for k in shared) or v.kind not in ("long", "double"):
        return None
    amount = number(v) if v.kind == "double" else v.column if value in right.non_null else F.coalesce(v.column, F.lit(0))
    found = running(left.df, [(left.columns[k], right.columns[k]) for k in shared], left.columns[here], right.df, right.columns[there], amount, op)
    times = left.df.groupBy(*[left.columns[k] for k in dict.fromkeys(keys)]).agg(F.count(F.lit(1)).alias("times"))
    on = F.col(left.columns[here]) == F.col("k")
    for i, k in enumerate(shared):
        on = on & F.col(left.columns[k]).eqNullSafe(F.col(f"g{i}"))
    total = F.col("times") * F.col("n" if aggs[0].name == "count" else "s")
    df = times.join(found, on).select(*[(total if isinstance(x, Agg) else F.col(left.columns[x.name])).alias(f"c{i}") for i, x in enumerate(rule.head.args)])
    kind = "long" if aggs[0].name == "count" else v.kind
    shown = [(f"{aggs[0].name}_{value}", kind, True) if isinstance(x, Agg) else (x.name, left.kinds[x.name], x.name in left.non_null) for x in rule.head.args]
    return Relation(df, *map(tuple, zip(*shown)), True)


def crossing(rule: Rule, resolve: Resolve) -> tuple[list[Relation], bool] | None:
    """The two stored tables that a rule pairs without a shared variable, and whether the head's columns tell their rows apart."""
    atoms = [x for x in rule.body if isinstance(x, Atom)]
    if rule.aggregates or len(atoms) != 2 or any(x.negated or x.rel == NEAREST for x in atoms) or set(variables(atoms[0])) & set(variables(atoms[1])):
        return None
    rels = [resolve(x) for x in atoms]
    if any(r is None or r.width != len(a.args) or not r.is_set for r, a in zip(rels, atoms)):
        return None
    if any(word in r.df._jdf.queryExecution().analyzed().toString() for r in rels for word in ("Join", "Aggregate", "Deduplicate", "Distinct")):
        return None
    head = {v for x in rule.head.args if isinstance(x, Var) for v in variables(x)}
    by = [[f"c{i}" for i, x in enumerate(a.args) if isinstance(x, Var) and x.name in head] for a in atoms]
    return rels, all(b and r.df.groupBy(*b).count().where("count > 1").isEmpty() for r, b in zip(rels, by))


def compile_rule(spark: SparkSession, rule: Rule, resolve: Resolve) -> Relation:
    """The head's rows, as a set."""
    aggs = rule.aggregates
    if aggs and (total := up_to(spark, rule, resolve)) is not None:
        return total
    body = BodyCompiler(spark, resolve, bool(aggs), rule)
    if cross := crossing(rule, resolve):
        body.sizes = [r.df.count() for r in cross[0]]
    frame = body.compile(rule.body)
    if cross and cross[1]:
        frame.exact, frame.from_atoms = True, set()
    if not aggs:
        values = [term(x, frame) for x in rule.head.args]
        df = frame.df.select(*[v.column.alias(f"c{i}") for i, v in enumerate(values)])
        shown = {x.name for x in rule.head.args if isinstance(x, Var)}
        non_null = tuple(isinstance(x, Const) or (isinstance(x, Var) and x.name in frame.non_null) for x in rule.head.args)
        names = tuple(x.name if isinstance(x, Var) else f"_c{i}" for i, x in enumerate(rule.head.args))
        rel = Relation(df, names, tuple(v.kind for v in values), non_null, frame.exact and frame.from_atoms <= shown)
        return rel.distinct()
    if not frame.exact:
        frame.df = frame.df.distinct()
    keys = [x for x in rule.head.args if isinstance(x, Var)]
    if aggs[0].name in RANKING:
        g = aggs[0]
        key_columns = [frame.columns[k.name] for k in keys]
        shown = [frame.columns[v.name] for v in g.vars]
        df = aggregates.ranked(frame.df, g.name, key_columns, shown, g.params, frame.columns[g.order], g.descending)
        out: list[str] = []
        for x in rule.head.args:
            out += [v.name for v in x.vars] if isinstance(x, Agg) else [x.name]
        df = df.select(*[F.col(frame.columns[v]).alias(f"c{i}") for i, v in enumerate(out)])
        return Relation(df, tuple(out), tuple(frame.kinds[v] for v in out), tuple(v in frame.non_null for v in out), False).distinct()
    named, kinds, names, non_null, columns = [], [], [], [], []
    for i, x in enumerate(rule.head.args):
        if isinstance(x, Agg):
            v = x.vars[0].name
            found = aggregates.simple(x.name, frame.typed(v), v in frame.non_null)
            named.append((f"a{i}", found.column))
            columns.append(f"a{i}")
            kinds.append(found.kind)
            names.append(f"{x.name}_{v}")
            non_null.append(x.name not in ("min", "max") or v in frame.non_null)
        else:
            columns.append(frame.columns[x.name])
            kinds.append(frame.kinds[x.name])
            names.append(x.name)
            non_null.append(x.name in frame.non_null)
    df = aggregates.grouped(frame.df, list(dict.fromkeys(frame.columns[k.name] for k in keys)), named)
    df = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return as_kinds(Relation(df, tuple(names), tuple(kinds), tuple(non_null), True), tuple(kinds))
